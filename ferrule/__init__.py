"""A supply-chain scanner and analytics engine whose operators are Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
