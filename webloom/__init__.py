"""webloom: website-intelligence processing as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that an executor needs no
# copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
