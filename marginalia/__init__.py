"""Notes, retrieval and task analytics as Spark jobs over tables."""
