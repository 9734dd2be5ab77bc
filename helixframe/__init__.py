"""A PySpark-native analytics engine for aligned biological sequences and their metadata."""
