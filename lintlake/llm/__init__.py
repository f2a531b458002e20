"""Training-data operators: ten Spark jobs over the corpus tables and the queries that apply them."""
