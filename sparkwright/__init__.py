"""A Spark-first engine for checking, reconciling and preparing document data."""
