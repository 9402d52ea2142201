"""A PySpark-native analytics engine for dated, multi-label texts and their vectors."""
