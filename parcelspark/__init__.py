"""Spark-native analytics for land-parcel boundary layers."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow kernels travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
