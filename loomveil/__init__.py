"""loomveil: private-document analytics and retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster
# needs no installed copy of it beside the driver's.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
