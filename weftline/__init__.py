"""Document, retrieval and event analytics expressed as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. Modules with
Python kernels ship them to the executors by value, so a job needs nothing
installed there beyond PySpark, pyarrow and numpy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
