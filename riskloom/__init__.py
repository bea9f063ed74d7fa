"""riskloom: cohort and risk analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# ship the package's small Python helpers with the tasks: executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
