"""Interview-transcript analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Responders and stream processors travel to the executors by value, so these need no
# installation of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
