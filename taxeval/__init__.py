"""PySpark-native evaluation of taxonomic classification and abundance profiling."""
