"""Operators of a training-data pipeline: sharding, licence scans, packing,
decontamination, near and exact duplicates, toxicity, quality and chat
formatting. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
