"""Small-area embedding analytics on Spark: every operator takes and returns DataFrames."""
