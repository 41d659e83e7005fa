"""A Spark-native engine for versioned knowledge graphs."""
