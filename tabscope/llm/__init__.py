"""Operators for preparing training text: counting, scoring, cleaning, packing and sharding."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
