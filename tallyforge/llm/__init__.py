"""Training-data operators: sharding, deduplication, quality, packing, privacy.

Nothing else in the library imports this package.  Functions that run inside
Python workers are shipped by value, so executors need not have the package on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
