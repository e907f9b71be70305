"""Session memory analytics on Spark: tiered tables, budgeted retrieval, temporal graph, vector search."""
