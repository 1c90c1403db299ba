"""Log analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Worker functions travel with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
