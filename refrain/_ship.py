"""Python workers may not have this package on their path; send its functions by value."""

import sys

from pyspark import cloudpickle


def ship_by_value() -> None:
    """Make closures over this package self-contained, so that executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
