"""Corpus operators for language-model training data.

Nothing else in the library imports this subpackage. Its functions are sent to
the executors by value, so that a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
