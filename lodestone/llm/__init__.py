"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions run on executors travel by value, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
