"""Electric-mobility corridor analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the job, so workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
