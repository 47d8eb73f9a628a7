"""histlake: command-history and captured-output analytics on Spark DataFrames."""

__version__ = "0.1.0"
