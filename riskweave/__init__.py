"""Transaction risk evaluation on Spark, in batch and as a stream."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
