"""Operators for training-data pipelines.

Each module holds one operator with its own general interface; ``registry`` holds the
registered queries, which apply the operators to whole tables, and their SQL checks.

Functions of this package that run in Python workers are sent there by value, so the package
need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
