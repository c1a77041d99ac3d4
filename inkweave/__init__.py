"""inkweave: Spark-native operators over aligned document collections and their ledgers."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so that the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
