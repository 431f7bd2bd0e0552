"""Operators of a training-data pipeline: dedup, token files, secrets, packing, quality, toxicity and more."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
