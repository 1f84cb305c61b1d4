"""ebbline: a PySpark-native engine for market-style time-series analytics."""
