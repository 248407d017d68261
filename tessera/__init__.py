"""tessera: retrieval, evaluation and corpus work as Spark jobs."""
