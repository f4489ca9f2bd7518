"""Helpers shared by the vector operators: usable rows, common length, integers, matrices.

``embeddings`` has ``vec_id long``, ``embedding array<float or double>`` and ``label``; other
columns are never read.  Vectors of different lengths are filled up with zeros
to the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 256 * x as a long; beyond that range it is the nearest long that a double can name.
SCALE, LONGEST = 256, float(2**63 - 1024)


def finite(embeddings: DataFrame, *columns: str) -> DataFrame:
    """(``columns``, v array<double>) of the rows whose vector is not null and has finite entries only."""
    def usable(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    return (embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", usable))
            .select(*columns, F.col("embedding").cast("array<double>").alias("v")))


def filled(rows: DataFrame, multiple: int = 1) -> tuple[DataFrame, int]:
    """(rows with ``v`` filled up with zeros to one length, that length): the longest, at
    least 1, rounded up to ``multiple``."""
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    dim = -(-longest // multiple) * multiple
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))), dim


def as_long(x: Column) -> Column:
    """floor(256 * x)."""
    return F.floor(F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), x * SCALE)))


def matrix(column: pa.Array, dim: int, dtype: type) -> np.ndarray:
    """An Arrow column of lists, all of length ``dim``, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), dim)


def roomy(a: np.ndarray, bits: float) -> np.ndarray:
    """``a`` as int64, or as Python integers where ``bits`` (log2 of the largest result) passes 62."""
    return a.astype(np.int64, copy=False) if bits < 62 else a.astype(object)


def log2_largest(a: np.ndarray) -> float:
    return float(np.log2(max(1.0, float(np.abs(a.astype(float)).max(initial=0)))))
