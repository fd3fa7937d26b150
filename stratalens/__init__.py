"""PySpark-native analytics for media collections: inventory, hashing, matching, ranking, reporting."""
