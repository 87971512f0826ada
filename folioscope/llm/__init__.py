"""Operators for large-scale training-data preparation.

Nothing else in the library imports this package. Its task functions are pickled by value, so
executors need only the third-party packages they use.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
