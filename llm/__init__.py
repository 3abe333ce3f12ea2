"""Training-data operators.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
