"""Retrieval and question answering over large document collections, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
