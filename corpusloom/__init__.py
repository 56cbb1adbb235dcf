"""Document-retrieval analytics as Spark jobs over tables of chunks, questions and logs."""
