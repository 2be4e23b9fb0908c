"""Field-survey analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
