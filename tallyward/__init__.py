"""Transaction-risk analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
