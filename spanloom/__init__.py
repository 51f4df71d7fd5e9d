"""Set-at-a-time analytics over agent-execution traces, on Spark DataFrames."""

__version__ = "0.1.0"
