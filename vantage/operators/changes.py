"""Change-only emission (C22, S9) and dashboard rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators.windows import prev_in_group


def content_hash(cols: Sequence[Column]) -> Column:
    """SHA-256 of a canonical JSON of the payload (fields in a fixed order)."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def changes_only(snapshots: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
                 ts_col: str = "ts", bucket: str = "30 days") -> DataFrame:
    """Keep a snapshot when its content hash differs from the previous
    snapshot of the same key (the first snapshot always counts).  The
    previous row comes from the time-bucketed ``prev_in_group``."""
    h = snapshots.withColumn("content_hash", content_hash([F.col(c) for c in payload]))
    p = prev_in_group(h, keys, order, ["content_hash"], ts_col=ts_col, bucket=bucket)
    return (p.filter(F.col("prev_content_hash").isNull() | (F.col("prev_content_hash") != F.col("content_hash")))
            .drop("prev_content_hash"))
