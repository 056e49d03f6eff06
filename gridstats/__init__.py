"""PySpark-native analytics for station, grid, reach and region tables."""
