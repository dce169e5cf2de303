"""tributary: Spark-first building blocks for ingestion and data preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
