"""ledgerline: evidence-linked historical measurements as PySpark DataFrame operators.

Its functions travel to executors by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
