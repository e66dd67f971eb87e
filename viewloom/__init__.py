"""Analytics over collections of views of a property graph, on Spark DataFrames."""
