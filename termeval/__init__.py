"""Spark-native evaluation of name-to-concept prediction pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the task, so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
