"""Operators for preparing training data. Nothing else in the library imports this package.

Functions of this package that run inside tasks are shipped with the task, so
executors need the third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
