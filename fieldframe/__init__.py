"""fieldframe: analysis of dynamic 4D scalar fields as Spark DataFrames."""
