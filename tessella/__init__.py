"""tessella: range analytics over 2-D points on Spark, with block layouts, workloads and metric tables.

Functions that run in Python workers are pickled by value, so workers need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
