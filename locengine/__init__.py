"""locengine - a localisation data engine on Spark DataFrames.

Documents become lines, runs and translatable segments; segments are looked up in a
translation memory, packed into batches, translated by a pluggable function, routed,
scored, exchanged for review and written back.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the task, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
