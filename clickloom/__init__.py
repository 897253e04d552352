"""Click-through-rate and recommendation analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

from clickloom.session import cut_lineage, get_spark

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["cut_lineage", "get_spark"]
