"""Operators for preparing training data. Nothing else in the library imports this folder."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers need not have this library on their path.
register_pickle_by_value(sys.modules[__name__])
