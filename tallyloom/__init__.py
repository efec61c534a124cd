"""Research-output reporting as Spark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# the batch functions travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
