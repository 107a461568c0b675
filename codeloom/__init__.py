"""Analytics over property graphs of source code, as Spark DataFrames."""
