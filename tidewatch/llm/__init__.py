"""Operators for preparing training text at scale; nothing else in the library imports them.

Their functions travel to the executors by value, so the package need not be there.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
