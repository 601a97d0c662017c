"""quarrystat: multivariate statistics and feature selection as Spark jobs.

A table is one row per sample: an ``id``, an optional label column and a
``features`` column of type ``array<double>``.  Every operator takes and
returns DataFrames; only vectors as long as the number of features (or small
matrices of that width) ever reach the driver.
"""

import sys

from pyspark import cloudpickle

# The Arrow kernels travel inside the task, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
