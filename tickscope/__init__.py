"""Market-tick anomaly analytics as Spark jobs, batch and streaming."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions and classes with the job itself, so
# they run wherever a worker starts, also the one that sets up streaming state.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
