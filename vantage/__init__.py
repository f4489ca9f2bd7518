"""vantage: telemetry analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Layout
------
sources/    readers: driver tables bound to the telemetry data model, log files,
            JSON batches, schema snapshots
functions/  scalar Column -> Column expressions (SQL normalising, error
            signatures, scoring, text helpers)
operators/  DataFrame(s), params -> DataFrame: windows, N+1, errors, budgets,
            profiles, access control, upgrade scans, table maintenance
plans/      named queries over the driver tables and their DuckDB oracles
streaming/  Structured Streaming twins of the batch operators
"""

from vantage.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
