"""Training-data operators (one module per operator) and their registered
queries (``queries.py``).  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# the functions that run in Python workers travel with the task, so executors
# need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
