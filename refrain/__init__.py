"""refrain: repeated-content analytics on Spark DataFrames."""

from refrain._ship import ship_by_value

__version__ = "0.1.0"

ship_by_value()
