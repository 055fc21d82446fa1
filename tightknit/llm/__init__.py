"""Operators that prepare text for training language models, one module each.

Functions of this package travel to the executors by value, so these need the
libraries it uses but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
