"""lendscope: credit-application analytics and scoring on Apache Spark.

Every public operator takes and returns Spark DataFrames (or small,
size-checked parameter objects fitted by a Spark aggregation), so the same
code runs on ``local[*]`` and on a cluster.
"""

__version__ = "0.1.0"
