"""Process analytics on Spark: every operator is DataFrame in, DataFrame out."""

__version__ = "0.1.0"

# Functions of this package travel to the workers inside the task, so a job
# needs no copy of the package on every machine.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
