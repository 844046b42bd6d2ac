"""Transaction analytics on Spark: ingest, categorise, roll up, query, compare."""
