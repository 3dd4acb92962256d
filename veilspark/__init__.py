"""veilspark: privacy-preserving clinical analytics expressed as Spark plans.

Functions that run in Python workers are pickled by value, so executors need Spark's Python and the third-party
libraries, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
