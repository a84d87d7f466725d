"""lodestone: evidence aggregation, report queries, quality rules and vector search as Spark plans."""
