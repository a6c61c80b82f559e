"""Outlier scoring, triage and evaluation for large labelled record tables on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that executors need neither
# an installed copy of the package nor an archive of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
