"""strandwork: corpus indexing, task-driven retrieval and change analysis on Spark DataFrames."""
