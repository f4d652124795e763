"""Operators of a training-data pipeline over a table of documents."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
