"""slackline: schedule-network analytics on PySpark.

Functions that run on executors are pickled by value, so the package need not be
installed on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
