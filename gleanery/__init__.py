"""A PySpark-native evidence-retrieval engine."""
