"""Catalog cleaning, classification, deduplication and quality engine on PySpark.

Functions that run in Python workers are shipped by value, so executors need
no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
