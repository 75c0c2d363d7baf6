"""Session time-series and text analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
