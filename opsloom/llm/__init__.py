"""Training-data pipeline operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
