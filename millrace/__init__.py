"""Data preparation on Spark: functions that take DataFrames and return DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
