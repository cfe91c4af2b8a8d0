"""Review analytics on Spark: ingest, describe, search, classify and score customer reviews."""
