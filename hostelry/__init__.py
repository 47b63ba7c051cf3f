"""Hospitality decision analytics and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
