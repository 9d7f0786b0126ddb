"""Operators for preparing training text, one module each, and their registered queries.

Functions that run in Python workers travel with their tasks, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
