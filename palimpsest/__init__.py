"""A PySpark-native analytics engine for long-lived text memories."""
