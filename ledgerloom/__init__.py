"""PySpark-native analytics over documents, orders and their evidence."""
