"""Spark-native transcript-to-interaction-graph engine.

Everything takes and returns DataFrames.  ``operators`` holds the relational, text and graph
operators, ``functions`` the column expressions and the few vectorised Python functions they need,
``sources`` the readers and writers, ``plans`` whole pipelines and the registered queries,
``streaming`` the incremental forms.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the workers by value, so executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
