"""Preference, window, disorder and spatio-temporal analytics on Spark DataFrames and streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
