"""Surveillance and cohort analytics as DataFrame -> DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few pandas functions with the plan itself, so executors need no copy of
# this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
