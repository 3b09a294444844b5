"""Sources and sinks.  What runs in tasks is pickled by value, so executors need no installed copy of the library."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
