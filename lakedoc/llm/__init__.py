"""Operations of a training-data pipeline, one module per operator.

Nothing outside this package imports it. Its functions travel to the executors by value,
so they need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
