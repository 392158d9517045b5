"""Data profiling, quality rules and feature associations as Spark jobs."""

import sys

from pyspark import cloudpickle

from tabscope.facade import profile
from tabscope.operators.profile import Profile
from tabscope.operators.quality import register_rule
from tabscope.operators.target import Target, detect_target, resolve_target
from tabscope.sources.readers import load_table, read_table, register_reader

__all__ = [
    "Profile",
    "Target",
    "detect_target",
    "load_table",
    "profile",
    "read_table",
    "register_reader",
    "register_rule",
    "resolve_target",
]

# Functions that run inside tasks travel with the job: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
