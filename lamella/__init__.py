"""Versioned key-value analytics on Spark: an append-only mutation log, reconciled by sets instead of by key.

Functions that run on executors are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
