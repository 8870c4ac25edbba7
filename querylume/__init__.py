"""A PySpark-native engine for schema catalogues, schema linking and SQL analysis."""
