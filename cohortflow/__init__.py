"""cohortflow: patient cohorts, example retrieval and evaluation as PySpark DataFrame operators."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the job, so executors need not have this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
