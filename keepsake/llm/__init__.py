"""Operators for training-data pipelines. Nothing else in the package imports this folder.

Functions that run in Python tasks travel with the job by value, so executors need numpy and
pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
