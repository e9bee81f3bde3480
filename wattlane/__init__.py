"""Device telemetry analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.  See the README
for the package map and for the rules each operator keeps at scale.
"""
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
