"""lodestone: a fact-graph analytics engine on PySpark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions are shipped to the executors by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
