"""cairn: a PySpark-native metadata-catalog, lineage and corpus analytics engine."""
