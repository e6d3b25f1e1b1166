"""Operators for training-data pipelines: dedup, scoring, mixing, search and tokenization.

Nothing else in the library imports this package. Its functions travel to the executors by value, so that a job
needs no installed copy there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
