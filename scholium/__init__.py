"""Evidence analytics engine expressed with Spark DataFrames."""
