"""A Spark-first engine for retrieval-augmented analytics over document collections."""
