"""tideframe: ordered, array-like and time-series analytics on Spark DataFrames."""
