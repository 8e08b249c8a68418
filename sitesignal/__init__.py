"""Contact-signal analytics over captured web pages, as Spark jobs."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel inside the UDFs, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
