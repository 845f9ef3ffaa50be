"""Spark-native analytics for biological sequences, sparse matrices and training corpora."""
