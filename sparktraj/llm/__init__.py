"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it can be imported.
"""
import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its kernels travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
