"""Document-extraction analytics as PySpark DataFrame operators.

Sub-packages
------------
``functions``  column expressions and the two vectorised Python kernels
``operators``  DataFrame-in, DataFrame-out operators (ordered scans, calls, pages, evaluation, reports)
``sources``    readers, writers and event-log access
``streaming``  Structured Streaming queries and state processors
``plans``      the registered queries, their inputs derived from the given tables and their oracle SQL
"""

import sys

from pyspark import cloudpickle

# The Python helpers that run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
