"""Document retrieval, relational and training-data operators as Spark plans.

Functions that run inside Spark's Python tasks are shipped by value, so executors need no
installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
