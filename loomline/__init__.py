"""Loomline: a Spark-first analytics engine for agent logs, evaluation runs and text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
