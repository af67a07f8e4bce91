"""scanlake: a PySpark-native engine for forensic analysis of binary file collections."""
