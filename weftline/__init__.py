"""Weftline: point-in-time relational analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so that executors need
# no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
