"""tickloom: intraday market time series on Spark DataFrames."""
