"""Operators for building training corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions for workers travel with their code: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
