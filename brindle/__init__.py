"""An analytics engine on Spark DataFrames."""
