"""Card-transaction risk analytics on Spark DataFrames, Structured Streaming and MLlib."""

import sys

from pyspark import cloudpickle

# the few Python functions that run on executors travel with the job, so nothing is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
