"""PySpark-native analytics over several pairwise-distance views of the same entities."""
