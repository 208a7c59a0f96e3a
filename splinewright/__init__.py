"""splinewright: additive models and training-data operators over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
