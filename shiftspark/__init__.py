"""shiftspark: work-schedule analytics on Spark.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates, windows and ``pyspark.ml``.  The clock
(``now``) is always a parameter, never ``current_timestamp()``.
"""

from shiftspark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
