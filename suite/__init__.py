"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from . import evaluation, features, retrieval, stores, texts  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as for the library: task functions travel with the job
