"""Operators for training-data pipelines, and their registered queries.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the tasks that call them, so that these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
