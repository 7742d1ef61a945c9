"""Search and exploration of media collections as Spark DataFrame programs.

Tables of requests are answered against tables of items, vectors and tags.
"""

import sys

from pyspark import cloudpickle

# The small Python kernels travel to the executors inside the task closure, so
# a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
