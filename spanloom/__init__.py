"""Spark-native analytics over LLM traces: versioned tables, filters, figures, feeds and retention."""

import sys

from pyspark import cloudpickle

# Executors that don't have this package get its functions by value with each job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
