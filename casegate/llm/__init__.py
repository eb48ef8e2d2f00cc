"""Operators for large training-data pipelines. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
