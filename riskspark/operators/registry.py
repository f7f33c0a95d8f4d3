"""Feature registry: named pillars as DataFrame builders, and the full vector."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.times import as_time
from riskspark.operators import behavior, context, monitor, network, profile


@dataclass(frozen=True)
class FeatureDefinition:
    """Catalogue entry of one feature."""
    name: str
    pillar: str
    data_type: str
    description: str = ""
    dependencies: tuple[str, ...] = ()
    ttl_seconds: int = 3600
    refresh: str = "daily"


@dataclass
class Inputs:
    """Tables the built-in pillars read."""
    customers: DataFrame
    transactions: DataFrame
    events: DataFrame
    products: DataFrame
    risk: DataFrame
    fraud_records: DataFrame
    as_of: object


Builder = Callable[[Inputs], DataFrame]


@dataclass(frozen=True)
class Pillar:
    """A group of features built together, and what holds for all of them."""
    builder: Builder
    key: str
    description: str
    dependencies: tuple[str, ...]
    ttl_seconds: int
    refresh: str


@dataclass
class FeatureRegistry:
    """Pillars by name; each builder returns one row per key."""
    pillars: dict[str, Pillar] = field(default_factory=dict)

    def register(self, pillar: str, builder: Builder, key: str = "customer_id", description: str = "",
                 dependencies: Sequence[str] = (), ttl_seconds: int = 3600, refresh: str = "daily") -> None:
        self.pillars[pillar] = Pillar(builder, key, description, tuple(dependencies), ttl_seconds, refresh)

    def build(self, pillar: str, inputs: Inputs) -> DataFrame:
        return self.pillars[pillar].builder(inputs)

    def refreshed(self, pillar: str, stored: DataFrame, wanted: DataFrame, inputs: Inputs) -> DataFrame:
        """Rows of ``wanted`` keys: stored ones within the pillar's time to live, the others built again.

        ``stored`` has the pillar's columns and ``computed_at``.
        """
        p = self.pillars[pillar]

        def recompute(stale: DataFrame) -> DataFrame:
            rows = self.build(pillar, inputs).join(stale, p.key, "left_semi")
            return rows.withColumn("computed_at", as_time(inputs.as_of)).select(*stored.columns)

        fresh = monitor.refresh(stored, wanted, recompute, [p.key], inputs.as_of, p.ttl_seconds)
        return fresh.select(*stored.columns)

    def feature_names(self, inputs: Inputs) -> dict[str, list[str]]:
        """Names per pillar, read off the output schema."""
        ids = {"customer_id", "transaction_id"}
        return {p: [c for c in self.build(p, inputs).columns if c not in ids] for p in self.pillars}

    def definitions(self, inputs: Inputs) -> list[FeatureDefinition]:
        ids = {"customer_id", "transaction_id"}
        return [FeatureDefinition(f.name, name, f.dataType.simpleString(), f"{p.description}: {f.name.replace('_', ' ')}",
                                  p.dependencies, p.ttl_seconds, p.refresh)
                for name, p in self.pillars.items() for f in self.build(name, inputs).schema.fields if f.name not in ids]

    def feature_vector(self, inputs: Inputs, pillars: Sequence[str] | None = None) -> DataFrame:
        """All customers with the columns of the customer-level pillars."""
        chosen = pillars or [name for name, p in self.pillars.items() if p.key == "customer_id"]
        out = inputs.customers.select("customer_id")
        for p in chosen:
            out = out.join(self.build(p, inputs), "customer_id", "left")
        return network.fill_network_defaults(out) if "network" in chosen else out.fillna(0)


def default_registry() -> FeatureRegistry:
    registry = FeatureRegistry()
    registry.register("profile", lambda i: profile.profile_features(i.customers, i.products, i.risk, i.as_of),
                      description="customer master data and products", dependencies=("customers", "products", "risk"),
                      ttl_seconds=86_400)
    registry.register("behavioral", lambda i: behavior.behavioral_features(i.transactions, i.events, i.as_of),
                      description="activity in trailing windows", dependencies=("transactions", "events"), refresh="hourly")
    registry.register("network", lambda i: network.network_features(i.transactions, i.fraud_records, i.as_of),
                      description="shared devices and transfer network", dependencies=("transactions", "fraud_records"),
                      ttl_seconds=21_600, refresh="every 6 hours")
    registry.register("contextual", lambda i: context.contextual_features(i.transactions, i.transactions, i.as_of),
                      key="transaction_id", description="transaction against the customer's history",
                      dependencies=("transactions",), ttl_seconds=300, refresh="per transaction")
    return registry


def vector_as_structs(wide: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Wide vector to one struct column per pillar."""
    return wide.select("customer_id", *[F.struct(*cols).alias(f"{p}_features") for p, cols in names.items()
                                        if all(c in wide.columns for c in cols)])


def to_long(wide: DataFrame) -> DataFrame:
    """Columns named ``feature_window`` to rows (customer, feature, window, value)."""
    names = [c for c in wide.columns if c != "customer_id"]
    as_double = wide.select("customer_id", *[F.col(c).cast("double").alias(c) for c in names])
    long = as_double.unpivot(["customer_id"], names, "__name", "feature_value")
    return long.select("customer_id",
                       F.regexp_extract("__name", "^(.*)_([^_]+)$", 1).alias("feature_name"),
                       F.regexp_extract("__name", "^(.*)_([^_]+)$", 2).alias("time_window"),
                       "feature_value")


def to_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long feature rows back to one column per ``feature_window`` name."""
    full = F.concat_ws("_", "feature_name", "time_window")
    return long.groupBy("customer_id").agg(*[
        F.max(F.when(full == n, F.col("feature_value"))).alias(n) for n in names])
