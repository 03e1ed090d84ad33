"""larder: a PySpark-native engine for catalogue data (mapping, cleaning, quality, dedup, search, recommendation, observability)."""
