"""notelake: a Spark-native engine for chunking, embedding, searching and evaluating note collections."""

__version__ = "0.1.0"
