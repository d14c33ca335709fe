"""A Spark-native engine that keeps vector embeddings of tabular text in step with their source tables."""
