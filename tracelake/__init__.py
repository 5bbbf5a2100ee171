"""Batch and streaming analytics over LLM-traffic traces, written for Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers travel to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
