"""Spark operators for the data work behind a large sharded database fleet."""

import sys

from pyspark import cloudpickle

# Functions and data sources that run in Python workers are shipped by value, so a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
