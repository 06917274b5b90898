"""Recommender analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the job, so workers need neither the package nor its folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
