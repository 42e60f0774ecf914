"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Its modules are pickled by value, so
executors need no copy of the library: the code that a task runs travels with the task.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
