"""lexmill: a Spark-native engine for preparing and querying text corpora."""
