"""Spark-native engine for building and evaluating attribute-aware retrieval data."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
