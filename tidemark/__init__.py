"""tidemark: event-time market tapes on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so nothing needs to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
