"""kilnflow: a PySpark-native analytics engine for process data."""
