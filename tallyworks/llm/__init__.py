"""Operators for preparing training corpora; nothing outside this package imports it.

Functions of this package travel to the Python workers by value, so executors need the
public libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
