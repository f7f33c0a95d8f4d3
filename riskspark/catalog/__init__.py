"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from riskspark.catalog import base
from riskspark.catalog import (decisions, explain, features, graph, identity,  # noqa: F401
                               models, monitor, sinks, streams, temporal, training_sets)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
