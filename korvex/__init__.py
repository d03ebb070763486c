"""korvex: Spark-native hybrid retrieval and corpus processing.

Functions handed to Spark workers are pickled by value, so executors need only
Python, pyarrow and numpy and no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
