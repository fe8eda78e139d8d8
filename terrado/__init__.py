"""A PySpark-native analytics engine for real-estate listings."""
