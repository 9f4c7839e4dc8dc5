"""Entity resolution and pairwise matching on Spark DataFrames."""
