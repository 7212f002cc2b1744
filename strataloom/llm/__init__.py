"""Operators for preparing large text corpora. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors unpickle the worker functions by value, so they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
