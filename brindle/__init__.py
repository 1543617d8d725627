"""brindle: a Spark-native engine for document retrieval, text analytics and corpus preparation."""

__version__ = "0.1.0"
