"""PySpark-native analytics for land-surface change."""
