"""fieldledger: territory analytics over messy master data, declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
