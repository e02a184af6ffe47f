"""Operators for preparing language-model training data, on DataFrames.

Nothing else in the library imports this subpackage. Worker code is pickled by value, so executors need
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
