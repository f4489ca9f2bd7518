"""Incremental pulls and query-statistics scans (SRC2, SRC3, F4, T1, T4).

``pull_since`` reads the next batch after a high-water mark (oldest first)
and returns the new mark as a one-row aggregate; the mark stays in Spark (the
streaming file source's checkpoint plays this role for streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Utility statements dropped from query statistics.
UTILITY_PREFIXES = ("SET %", "SHOW %", "RESET %", "DEALLOCATE %")
TRANSACTION_PATTERN = r"(?i)^(BEGIN|COMMIT|ROLLBACK)"
STAT_TOP = 500


def pull_since(df: DataFrame, id_col: str, hwm: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """SRC2: rows with id > hwm, oldest first, at most ``limit``; plus the new
    high-water mark (max id of the batch, or the old one when empty)."""
    batch = df.filter(F.col(id_col) > F.lit(hwm)).orderBy(F.col(id_col)).limit(limit)
    mark = batch.agg(F.coalesce(F.max(id_col), F.lit(hwm)).alias("hwm"))
    return batch, mark


def without_utility(stats: DataFrame, query_col: str = "query") -> DataFrame:
    """drop SET / SHOW / RESET / DEALLOCATE and transaction statements."""
    q = F.col(query_col)
    keep = F.lit(True)
    for p in UTILITY_PREFIXES:
        keep = keep & ~q.like(p)
    return stats.filter(keep & ~q.rlike(TRANSACTION_PATTERN))


def stat_snapshot_scan(stats: DataFrame, keys=("env_id",), total_col: str = "total_ms",
                       top: int = STAT_TOP) -> DataFrame:
    """SRC3: utility statements removed, then the top ``top`` statements by
    total time per key (``row_number() <= top`` plans a WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(F.col(total_col).desc(), F.col("query"))
    return (without_utility(stats).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .withColumn("rank", F.col("rank").cast("long")))
