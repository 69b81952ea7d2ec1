"""Spark-native operators for sequence and genomic-signal tables.

Every operator takes and returns a lazy DataFrame.  Tables are long and keyed
by name: a matrix is ``(row, col, value)``, a sequence is ``(name, seq)``, a
motif is ``(motif, pos, base, w)``, an attribution map is
``(seq, track, pos, base, value)``.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
