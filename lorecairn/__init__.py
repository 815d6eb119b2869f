"""Knowledge-base analytics on Spark."""

import sys

from pyspark import cloudpickle

# The small functions that run inside Python workers travel with the plan, so
# the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
