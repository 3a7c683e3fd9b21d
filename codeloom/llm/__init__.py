"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. Its Python functions
travel to the workers by value, so a cluster needs nothing installed for them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
