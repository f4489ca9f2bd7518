"""Helpers shared by the text operators: Arrow batch size, word hashes, shingles.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z only.  In UTF-8 that is a run of the bytes ``0-9 a-z 80-FF``, so words are
found on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch holds whole texts, so it is kept small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Longest piece, in bytes, that is hashed at once (cut between words).
SEGMENT = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32(doc_id as text) mod 4 = 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every bit of ``h`` reaches every bit of the result."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_WORD = np.zeros(256, np.int8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) * _WORD.astype(_U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW, _INV = _powers(_BASE, 4096), _powers(pow(_BASE, -1, 1 << 64), 4096)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, m), _powers(pow(_BASE, -1, 1 << 64), m)
    return _POW, _INV


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased (``bytes.lower`` changes ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of at most about ``SEGMENT`` bytes, cut between words."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and _WORD[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of every word of lower-cased ``data``.

    The hash of a word is a polynomial over its bytes.  One running sum serves
    all words: the part of a word is a difference of two sums, moved back to
    exponent 0 by the inverse power of its start.
    """
    starts, ends, hashes = [], [], []
    for at, piece in segments(data):
        a = np.frombuffer(piece, np.uint8)
        edge = np.diff(_WORD[a], prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _tables(len(a) + 1)
        total = np.zeros(len(a) + 1, _U)
        np.cumsum(_BYTE[a] * power[: len(a)], dtype=_U, out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text that
    has words is one run, a text without words has none."""
    n = len(hashes)
    k = min(size, n)
    if not k:
        return np.zeros(0, _U)
    factor = _powers(0xD1342543DE82EF95, size + 1)[1:]
    run = np.zeros(n - k + 1, _U)
    for i in range(k):
        run += hashes[i : n - k + 1 + i] * factor[i]
    return np.unique(mix(run))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run ``hashes[start:end]``, the same wherever the run stands."""
    power, inverse = _tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power[: len(hashes)], dtype=_U, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
