"""Customer analytics for retail and loyalty data, written as Spark plans."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
