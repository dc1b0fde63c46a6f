"""Climate-shock, scenario and river-ecology analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel by value, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
