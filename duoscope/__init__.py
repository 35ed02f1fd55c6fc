"""duoscope: PySpark-native analytics for two-modality sparse count data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code: the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
