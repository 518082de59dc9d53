"""A Spark-native engine for time-series ingest, tiered storage and SQL analytics."""
