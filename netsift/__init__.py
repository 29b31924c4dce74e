"""netsift: network-flow analytics on Spark DataFrames, Spark ML and Structured Streaming."""

__version__ = "0.1.0"
