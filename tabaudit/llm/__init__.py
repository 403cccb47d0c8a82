"""Operators for text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get the functions of this subpackage with the task, so that they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
