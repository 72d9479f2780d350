"""Equity-research panel analytics on Spark: long (tic, date) tables in, long tables out."""

import sys

from pyspark import cloudpickle

# Small helpers that run inside pandas tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
