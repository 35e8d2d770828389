"""lodestar: a PySpark-native engine for retrieval corpora and knowledge graphs."""
