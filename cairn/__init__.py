"""A Spark-native engine for versioned key-value and document data."""
