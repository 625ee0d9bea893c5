"""Spark-native cleaning of memory-checker logs and scoring of code changes.

Everything is a DataFrame in, DataFrame out function; nothing runs until the
caller asks Spark for a result.
"""

from logsift.options import CleanOptions
from logsift.plans.clean import clean

__all__ = ["CleanOptions", "clean"]
