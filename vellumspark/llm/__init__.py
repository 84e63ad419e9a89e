"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Functions that Spark runs on
executors are pickled by value, so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
