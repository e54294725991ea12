"""A PySpark-native engine for document, link, vector and graph analytics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so that a cluster whose workers have no copy of
# this package can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
