"""Operators of a training-data pipeline: one module each, plus their registered queries."""

import sys

from pyspark import cloudpickle

# Workers need not have the repository on their path: functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
