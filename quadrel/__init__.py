"""quadrel: quad indexing, retrieval and ranking as Spark DataFrame plans."""
