"""Analytics over evaluation records, as Spark DataFrames."""
