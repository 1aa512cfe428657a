"""freightlens: analytics over city freight data, written as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions of the package travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
