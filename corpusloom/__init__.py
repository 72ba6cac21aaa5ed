"""A Spark-native engine that answers retrieval questions over large text corpora."""
