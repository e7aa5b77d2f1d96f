"""provscan: provenance inspection, style scoring and corpus statistics on Spark DataFrames."""

from pyspark import cloudpickle
import sys

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
