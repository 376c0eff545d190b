"""A Spark-native engine for mining parallel text from web crawls."""
