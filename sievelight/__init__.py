"""A Spark-native engine for evaluating data that arrives through a noisy channel."""
