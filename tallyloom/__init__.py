"""Rollout analytics as DataFrame and Column operators.

The modules of this package travel to the executors by value, so a cluster
needs no installed copy of them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
