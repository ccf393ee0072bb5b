"""PySpark-native vector search: exact and approximate k-nearest neighbours, index upkeep, sources and sinks."""
