"""marlstone: retrieval, evaluation and corpus preparation as Spark DataFrames."""
