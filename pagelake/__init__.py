"""An engine for large collections of page texts: everything is a DataFrame operation."""

import sys

from pyspark import cloudpickle

# functions travel to executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
