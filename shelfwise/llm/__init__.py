"""Operators for preparing training text, each a function from DataFrames to DataFrames.

Nothing else in the library imports this package. Its functions that run in Python workers are
shipped by value, so that the workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
