"""Vector code compression: product codes learned and assigned in exact integers.

1. Entries become ``floor(256 * x)``; a vector is cut into ``PARTS`` equal consecutive parts.
2. A part position's codebook starts as that part of the ``ENTRIES`` rows of smallest vec_id.
   Each of ``ROUNDS`` rounds assigns every part to the nearest entry and replaces an
   entry by the floor of the mean of its parts; unused entries stay.
3. Nearest entries are found in the Walsh-Hadamard domain.  Parts and entries are
   filled up with zeros to P = a power of two and transformed by additions alone; the
   transform keeps squared distances, scaled by P.  Coefficients are taken in
   sequency order, where the slow, heavy ones come first: the entry that is nearest by the first one gives
   an upper bound, and an entry whose partial sum passes the bound is gone.  Sums
   are integers, so ties (lower index wins) are exact.

A round is one pass over the rows: tasks add up sums and counts of at most
PARTS x ENTRIES entries, Spark adds those, and the codebooks (as many numbers as
ENTRIES vectors have) are sent to the tasks.  Rows are never shuffled before they are coded.

Results for odd input: rows with a null vector, or with null or non-finite entries,
are dropped; vectors of unequal lengths, or of a length that PARTS does not divide, are filled up with
zeros; repeated rows are rows; with fewer than ENTRIES rows there are as many
entries; rows of one vec_id are ordered by their vectors, null vec_ids come
last; null labels are one label; an empty table gives no rows; entries too large for
64-bit sums are computed with Python integers, and an ``error`` that no long holds is
null, as is its ``label_error``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.vectors import as_long, filled, finite, log2_largest, matrix, roomy
from vantage.session import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows coded at once, and copies of a label's total (a label may hold most rows).
CHUNK, SALTS = 4096, 16


def sequency_order(p: int) -> np.ndarray:
    """Rows of the p x p Hadamard matrix in order of their sign changes: Gray code, bits reversed."""
    bits = p.bit_length() - 1
    return np.array([int(format(i ^ (i >> 1), f"0{bits}b")[::-1], 2) if bits else 0 for i in range(p)])


def walsh_hadamard(a: np.ndarray) -> np.ndarray:
    """The transform of the last axis, zero-padded to a power of two, in sequency order."""
    n = a.shape[-1]
    p = 1 << (n - 1).bit_length()
    out = np.zeros((*a.shape[:-1], p), a.dtype)
    out[..., :n] = a
    h = 1
    while h < p:
        pair = out.reshape(*a.shape[:-1], p // (2 * h), 2, h)
        out = np.stack([pair[..., 0, :] + pair[..., 1, :], pair[..., 0, :] - pair[..., 1, :]], axis=-2).reshape(*a.shape[:-1], p)
        h *= 2
    return out[..., sequency_order(p)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each transformed part's nearest transformed entry, lower index first."""
    p, k = parts.shape[1], len(entries)
    total = (parts[:, None, 0] - entries[None, :, 0]) ** 2
    first = total.argmin(axis=1)
    bound = ((parts - entries[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= bound[:, None])
    total = total[row, entry]
    for s in range(1, p):
        total = total + (parts[row, s] - entries[entry, s]) ** 2
        stays = (total <= bound[row]).astype(bool)
        row, entry, total = row[stays], entry[stays], total[stays]
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # the entry that gave the bound is always left
    best = np.minimum.reduceat(total * k + entry, starts)
    return (best % k).astype(np.int64), best // k // p


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts of each row of ``x``; ``books`` is parts x entries x width."""
    parts, k, width = books.shape
    bits = 2 * (max(log2_largest(x), log2_largest(books)) + 1) + 2 * np.log2(2 * width) + np.log2(k)
    x, books = roomy(x, bits), roomy(books, bits)
    code, distance = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), x.dtype)
    for j in range(parts):
        if len(x):
            code[:, j], distance[:, j] = nearest(walsh_hadamard(x[:, j * width : (j + 1) * width]), walsh_hadamard(books[j]))
    return code, distance


def chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, matrix(part.column("x"), dim, np.int64)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, k, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * k, width + 1), object)  # the last column counts
        for _, x in chunks(batches, parts * width):
            code, _ = coded(x, books)
            slot = (code + np.arange(parts) * k).ravel()
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            each = np.c_[x.reshape(-1, width), np.ones(len(slot), np.int64)][order]
            each = roomy(each, log2_largest(x) + np.log2(len(slot)))
            total[slot[order][starts]] += np.add.reduceat(each, starts, axis=0)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.repeat(used, width + 1), pa.int32()),
            "at": pa.array(np.tile(np.arange(width + 1), len(used)), pa.int32()),
            "total": pa.array([Decimal(int(t)) for t in total[used].ravel()], pa.decimal128(38, 0))})

    got = (rows.select("x").mapInArrow(sums, "slot int, at int, total decimal(38,0)")
           .groupBy("slot", "at").agg(F.sum("total").alias("total")).collect())  # at most entries x (width + 1) rows
    total: dict[int, dict[int, int]] = {}
    for r in got:
        total.setdefault(r["slot"], {})[r["at"]] = int(r["total"])
    new = books.copy()
    for slot, t in total.items():
        new[slot // k, slot % k] = [t[i] // t[width] for i in range(width)]
    return new


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes array<int>, error) of every kept row, final codebooks as parts x entries x width)."""
    rows, dim = filled(finite(embeddings, "vec_id", "label"), parts)
    rows = rows.select("vec_id", "label", F.transform("v", as_long).alias("x"))
    width = dim // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not len(first):
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        books = refined(rows, books)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # as large as ``entries`` vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in chunks(batches, dim):
            code, distance = coded(x, sent.value)
            error = distance.astype(object).sum(axis=1)
            ends = np.arange(0, code.size + 1, parts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"),
                 pa.ListArray.from_arrays(ends, pa.array(code.ravel(), pa.int32())),
                 pa.array([e if e < 2**63 else None for e in error], pa.int64())], ["vec_id", "label", "codes", "error"])

    label = dict(rows.dtypes)["label"]
    return rows.mapInArrow(assign, f"vec_id long, label {label}, codes array<int>, error long"), books


def with_label_error(coded_rows: DataFrame) -> DataFrame:
    """``label_error``, the errors of all rows of one label, beside each row."""
    rows = written(coded_rows).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    whole = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    total = (rows.groupBy("label").agg(whole.alias("label_error"))
             .select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    return rows.join(total, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s", "salt")


def code_table(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    rows, books = vector_codes(embeddings)
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_error(rows).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
