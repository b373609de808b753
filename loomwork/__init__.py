"""loomwork: routing, sequence and corpus analytics on Spark DataFrames."""
