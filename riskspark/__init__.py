"""Payment-risk analytics on Spark: features, identity, graph, models, decisions."""
