"""A PySpark-native engine for lineage, deduplication and verification of derived files."""
