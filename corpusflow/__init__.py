"""corpusflow: a PySpark-native engine for corpus preparation and hybrid retrieval."""
