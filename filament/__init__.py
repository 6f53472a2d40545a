"""filament: a Spark-first engine for append-only, timestamped event threads."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the task, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
