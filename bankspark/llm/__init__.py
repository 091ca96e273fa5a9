"""Operators for training-data pipelines over web documents.

Nothing else in the library imports this subpackage. Its functions are sent to the tasks by
value, so executors do not need a copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
