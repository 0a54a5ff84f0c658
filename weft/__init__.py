"""weft: leakage-safe table analytics and supervised workflows on Spark DataFrames."""

__version__ = "0.1.0"
