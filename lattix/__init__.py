"""Spark-native analytics over typed, linked document collections."""

import sys

from pyspark import cloudpickle

# functions go to executors with their code, so that these need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
