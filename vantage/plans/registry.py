"""Named queries over the driver tables, each with an optional DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``.  ``sql`` is the equivalent
DuckDB statement over the driver tables registered as views; ``None`` marks a
query whose semantics are not SQL-expressible (ordered folds, stateful
streams), which is then checked against a brute-force test instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None, ops: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            # event times are wall-clock (NTZ) values: every cast and window in
            # the library assumes the session time zone is UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return to_ntz(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, wrapped, sql.strip() if sql else None, ops)
        return wrapped
    return deco


def to_ntz(df: DataFrame) -> DataFrame:
    """Results expose wall-clock timestamps (TIMESTAMP_NTZ, UTC session) so
    they compare equal to the naive timestamps of the source files."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
