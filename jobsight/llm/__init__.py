"""Operators of a training-data pipeline (deduplication, scoring, packing,
extraction, archives, sharding). Nothing else in the package imports this one.

The functions that run in tasks travel by value, so executors need the listed
libraries but no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
