"""Cohort and feature analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: its small task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
