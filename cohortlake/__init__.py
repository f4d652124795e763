"""Labelled sequence and multi-omics feature analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Column functions travel to the executors inside the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
