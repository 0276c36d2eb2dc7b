"""Training-data operators: license scan, line dedup, BPE, media columns, substring and near dedup, packing, toxicity.

Nothing else in the library imports this subpackage. Its task functions travel to the executors by value, so a
cluster needs no copy of the repository on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
