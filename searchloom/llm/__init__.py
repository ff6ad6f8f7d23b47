"""Training-data operators. Nothing outside this subpackage imports it.

Functions sent to Python workers are pickled by value, so that executors need
no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
