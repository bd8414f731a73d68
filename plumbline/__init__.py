"""plumbline: profile, clean and model tabular data with plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions with the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
