"""corpusforge: turn document collections into training datasets with plain Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the few pandas functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
