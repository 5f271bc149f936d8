"""A PySpark-native engine for bisulfite-sequencing methylation data."""
