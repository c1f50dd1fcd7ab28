"""velum: finding and handling personal data in Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "1.0.0"

# Functions that run in Python workers travel with the task, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
