"""Integrity analytics for labelled feature tables, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
