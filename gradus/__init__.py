"""gradus: learner-model, assessment and knowledge-graph analytics as Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
