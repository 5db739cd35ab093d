"""Lamina: text chunking, retrieval and corpus preparation as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value: no wheel or
# PYTHONPATH has to be there first.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
