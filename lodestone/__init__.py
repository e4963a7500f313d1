"""A Spark-native engine for search corpora: loading, chunking, indexing, retrieval, matching, evaluation."""
