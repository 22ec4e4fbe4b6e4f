"""corvane: text and vector retrieval, prediction scoring and comparison on Spark.

Functions take and return DataFrames or Columns. The few Python kernels are
shipped to executors by value, so that a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
