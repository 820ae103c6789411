"""Operators of a training-data pipeline; nothing else in the package imports them.

Executors need no installed copy: the functions that run in tasks travel with the query.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
