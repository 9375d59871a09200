"""loamgrid: a PySpark-native engine for site-by-individual analytics and text corpora.

Functions of this package travel to Python workers by value, so that a cluster
needs no copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
