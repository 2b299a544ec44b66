"""A PySpark-native engine for labelled time series."""
