"""Edge partitioning of large graphs on Spark DataFrames."""
