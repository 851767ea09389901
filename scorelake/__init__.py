"""Symbol-stream and page-layout analytics on Spark DataFrames."""
