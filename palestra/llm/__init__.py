"""Operators for training data: packing, scans, deduplication, archives, chat logs.

Nothing outside this subpackage imports it. Its functions travel to the executors by
value, so that a cluster needs no copy of the library on its machines.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
