"""Data inventory, profiling, content census and delivery accounting on Spark."""

import sys

from pyspark import cloudpickle

# Worker-side helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
