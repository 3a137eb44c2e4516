"""A PySpark-native analytics engine for file catalogues."""
