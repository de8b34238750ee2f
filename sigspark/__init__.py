"""Bulk feature extraction, event detection and model evaluation for multi-channel recordings on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the Arrow helper functions with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
