"""weaveline: a Spark-native engine for linked document collections.

Scans, regions, units, vectors, nearest neighbours, link graphs, pair features,
ranking, anchors, spans and evaluation, each as a DataFrame-to-DataFrame
operator.  Functions that run in Python workers are pickled by value, so the
executors need Python and the third-party packages, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
