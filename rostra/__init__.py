"""rostra: a PySpark-native engine for attributed document collections."""
