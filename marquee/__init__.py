"""Catalogue scoring and weighted similarity search on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
