"""A PySpark-native analytics engine for versioned entity feeds."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need
# no copy of the package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
