"""Operators for preparing training data: cleaning, deduplication, tokens, sharding, formatting.

Nothing outside this folder imports it. Each module holds one operator; ``queries`` applies
them to the test tables and ``oracles`` holds the SQL that must agree.
"""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors with the tasks that call them, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
