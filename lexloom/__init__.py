"""lexloom: a PySpark-native text-corpus analytics engine."""
