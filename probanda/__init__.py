"""A Spark-native engine for claims about collections of experiment runs."""
