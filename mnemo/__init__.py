"""mnemo: a Spark-native engine for building, checking, combining and
evaluating sets of features about the same items.

Every operator takes and returns DataFrames; heavy work runs as Spark SQL
expressions, joins, windows and Spark ML estimators.
"""

__version__ = "0.1.0"
