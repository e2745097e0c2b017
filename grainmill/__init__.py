"""Grainmill: dataset curation, auditing and scoring as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
