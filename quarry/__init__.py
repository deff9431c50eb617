"""quarry: a PySpark-native retrieval-analytics library of pure DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions go to executors with their code, so that these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
