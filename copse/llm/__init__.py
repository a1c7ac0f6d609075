"""Operators for preparing training data, each one a module of this subpackage.

Nothing outside of this subpackage imports it.  Functions that run in Python workers are pickled by
value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
