"""Document-library analytics on Spark.

The package is shipped to Python workers by value, so that a job works the same
whether or not the executors have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
