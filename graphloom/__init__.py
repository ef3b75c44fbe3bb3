"""Documents and tables to a queryable knowledge graph, as Spark DataFrames."""
