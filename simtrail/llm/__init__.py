"""Operators for preparing training text (thirteen operators and their queries).

Nothing else in the library imports this subpackage.  Its task functions are
pickled by value, so executors need only the public Python packages.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
