"""spanveil: find, mask and score personal data in text with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that the
# package needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
