"""Retail-demand panels and quantile-forecast evaluation as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
