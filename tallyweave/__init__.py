"""tallyweave: an event-time tally engine for Spark whose results can be verified.

Batch operators are functions from DataFrame to DataFrame; the streaming package
runs the same definitions under Structured Streaming.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
