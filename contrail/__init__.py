"""contrail — Spark-native flight-telemetry analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function with explicit
parameters (``as_of`` instead of a wall clock), so the same code runs in
batch, in ``foreachBatch`` and, where the operator is stateless, directly
on a streaming DataFrame.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their helpers with them, so that
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
