"""Operators for preparing training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
