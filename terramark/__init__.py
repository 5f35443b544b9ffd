"""Land-use change analytics on Spark DataFrames."""
