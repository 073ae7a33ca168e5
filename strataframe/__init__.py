"""A PySpark-native analytics engine: DataFrames, Spark SQL and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
