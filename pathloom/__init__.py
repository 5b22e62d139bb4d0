"""Analytics over routing-update streams and graph snapshots, on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need no copy of the package: its Python functions travel with the tasks.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
