"""Trussline: schedule analytics and training-data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
