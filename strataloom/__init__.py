"""strataloom: a PySpark-native engine for code-graph and evidence analytics."""
