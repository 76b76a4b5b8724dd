"""Docketry: Spark jobs that turn large paged files into searchable tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job: executors need no copy of
# this package, and a driver may import it from any path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
