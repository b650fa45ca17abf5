"""Spark-native analytics for multi-channel physiological signals.

Functions of this package that run in Python workers are pickled by value, so
a cluster's executors need no copy of the package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
