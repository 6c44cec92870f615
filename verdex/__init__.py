"""verdex: a PySpark-native engine for typed-decision datasets."""
