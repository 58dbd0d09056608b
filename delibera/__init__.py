"""delibera: a Spark-native engine for discussion records, panels and training text."""
