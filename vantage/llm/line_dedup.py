"""Line deduplication by overlapping windows of three lines.

A *line* ends at a line break, or behind ``.``, ``!`` or ``?`` with white space
after it.  A line of more than ``WRAP`` words is wrapped where its words say so: in
front of each word whose hash is the smallest among the ``REACH`` words on either
side.  Equal passages are thus wrapped alike after a few words, wherever they stand.
Lines are compared by their words (A-Z lower-cased); what stands between two
words belongs to the line before, and a line without words is no line.

1. Every run of ``WINDOW`` lines is hashed, however short its lines; it goes with
   the doc_id.
2. A window is repeated if two documents have it: smallest and largest doc_id of
   its hash differ (a map-side aggregate, no list of documents).
3. A repeated window is removed everywhere but in the document with the smallest
   doc_id; inside one document every occurrence after the first goes too.
4. A document's covered lines are merged and cut out of its text.

Whatever is cut still stands once: cut lines have an earlier equal occurrence,
and the earliest of them is never cut.

Results for odd input: null and empty texts, and texts of fewer than three lines,
stay as they are; rows that share a doc_id count as one document (an occurrence
in one of them is no repetition of one in another); rows without doc_id are
documents of their own behind all others, one for each text; other columns are carried along, whatever their
names.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.text import lowered, mix, run_hashes, small_batches, words

WINDOW = 3
#: Words of the longest line that is not wrapped.
WRAP = 16
#: Words to either side of a wrap whose hashes are larger; wraps are more than so many words apart.
REACH = 3
#: Most words without a wrap (in words that repeat periodically no hash is the smallest).
LONGEST = 32
#: Characters of texts that are cut into lines together (one longer text is a piece of its own).
PIECE = 1 << 17
#: Rows without doc_id take keys from here on.
_UNNAMED = 1 << 62

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def _wraps(hashes: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Marks of the words that begin a line: those of ``new``, and wraps inside long lines."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    if not (size > WRAP).any():
        return new
    line = np.cumsum(new) - 1
    tied = (size > WRAP)[line] & ~new  # smallest, or equal to the smallest
    least = tied.copy()  # the first smallest one
    for d in range(1, REACH + 1):
        same, left, right = line[d:] == line[:-d], hashes[:-d], hashes[d:]
        least[d:] &= ~same | (right < left)
        tied[d:] &= ~same | (right <= left)
        least[:-d] &= ~same | (left <= right)
        tied[:-d] &= ~same | (left <= right)
    out = new | least
    first = np.flatnonzero(out)
    end = np.append(first[1:], len(out))
    far = end - first > LONGEST
    if far.any():
        ties = np.flatnonzero(tied)
        for a, b in zip(first[far].tolist(), end[far].tolist(), strict=True):
            while b - a > LONGEST:
                k = np.searchsorted(ties, a + WRAP, side="right")
                a = min(int(ties[k]) if k < len(ties) else b, a + LONGEST)
                out[a] = True
    return out


def lines(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased ``data``: byte where each line's first word begins, its number
    of words, its hash."""
    start, end, hashes = words(data)
    if not len(start):
        return start, start, hashes
    a = np.frombuffer(data, np.uint8)
    ends_line = (a == 10) | (a == 13)
    ends_line[1:] |= _STOP[a[:-1]] & _SPACE[a[1:]]
    seen = np.concatenate([[0], np.cumsum(ends_line)])
    new = np.concatenate([[True], seen[start[1:]] > seen[end[:-1]]])
    first = np.flatnonzero(_wraps(hashes, new))
    last = np.append(first[1:], len(start))
    return start[first], last - first, run_hashes(hashes, first, last)


def windows(count: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, hash) of every window of lines with ``count`` words and ``hashes``."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    return at, run_hashes(hashes, at, at + WINDOW).view(np.int64)


def pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about ``PIECE`` characters; one array pass serves a list."""
    piece, size = [], 0
    for t in texts:
        piece.append(t or "")
        size += len(piece[-1])
        if size > PIECE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """All texts lower-cased in one, a line break between them, and where each begins (and the end)."""
    datas = [lowered(t) for t in texts]
    return b"\n".join([*datas, b""]), np.cumsum([0, *(len(d) + 1 for d in datas)])


def _windows_of_all(data: bytes, begin: np.ndarray):
    """(line starts, first line of each window, its hash, its text) over joined texts."""
    start, count, hashes = lines(data)
    owner = np.searchsorted(begin, start, side="right") - 1
    at, h = windows(count, hashes)
    inside = owner[at] == owner[at + WINDOW - 1] if len(at) else np.zeros(0, bool)
    return start, owner, at[inside], h[inside]


def cut_all(texts: list[str], gone: list[np.ndarray | None]) -> list[tuple[str, int, int]]:
    """(text without covered lines, lines, lines removed) of each text; ``gone``: its windows
    that stand in an earlier document."""
    data, begin = _joined(texts)
    start, owner, at, h = _windows_of_all(data, begin)
    n_lines = np.bincount(owner, minlength=len(texts))
    # later occurrences in the same text
    later = np.ones(len(h), bool)
    later[np.unique(mix(h.view(np.uint64) + mix(owner[at].astype(np.uint64))), return_index=True)[1]] = False
    edge = np.searchsorted(owner[at], np.arange(len(texts) + 1))
    for i, g in enumerate(gone):
        if g is not None and len(g):
            part = slice(edge[i], edge[i + 1])
            later[part] |= np.isin(h[part], g)
    if not later.any():
        return [(t, int(n), 0) for t, n in zip(texts, n_lines, strict=True)]
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, at[later], 1)
    np.add.at(covered, at[later] + WINDOW, -1)
    drop = np.cumsum(covered)[:-1] > 0
    n_drop = np.bincount(owner[drop], minlength=len(texts))
    line = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        if n_drop[i]:
            t = _without(t, start[line[i] : line[i + 1]] - begin[i], drop[line[i] : line[i + 1]])
        out.append((t, int(n_lines[i]), int(n_drop[i])))
    return out


def _without(text: str, start: np.ndarray, drop: np.ndarray) -> str:
    """``text`` without the lines ``drop``; a line reaches to the first word of the next one."""
    raw = text.encode("utf-8", "surrogatepass")
    edge = np.append(start, len(raw))
    change = np.diff(drop.astype(np.int8), prepend=0, append=0)
    kept, past = [], 0
    for a, b in zip(edge[np.flatnonzero(change == 1)], edge[np.flatnonzero(change == -1)], strict=True):
        kept.append(raw[past:a])
        past = b
    return b"".join([*kept, raw[past:]]).decode("utf-8", "surrogatepass")


def _key() -> Column:
    """doc_id, or for rows without one a large number that follows from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_UNNAMED) + F.pmod(F.xxhash64("text"), F.lit(_UNNAMED)))


def window_rows(docs: DataFrame) -> DataFrame:
    """(h, id): the window hashes of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column("id").to_numpy(), 0
            for texts in pieces(batch.column("text").to_pylist()):
                own = ids[done : done + len(texts)]
                done += len(texts)
                _, owner, at, h = _windows_of_all(*_joined(texts))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(own[owner[at]])], names=["h", "id"])

    return (docs.select(_key().alias("id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .mapInArrow(rows, "h long, id long"))


def removals(docs: DataFrame) -> DataFrame:
    """(id, gone): the windows to remove from each document that has any."""
    rows = window_rows(docs)
    repeated = (rows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                .filter("first < last").select("h", "first"))
    return (rows.join(repeated, "h").filter("id > first")
            .groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("gone")))


def _deduplicated(docs: DataFrame) -> DataFrame:
    """(doc, cut): every row as a struct, and its cut text with counts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            out, done = [], 0
            for piece in pieces(texts):
                some = gone.iloc[done : done + len(piece)]
                done += len(piece)
                out += cut_all(piece, [None if g is None else np.asarray(g, np.int64) for g in some])
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    gone = removals(docs)
    whole = docs.select(_key().alias("id"), F.struct("*").alias("doc"))
    done = whole.join(gone, "id", "left").select("doc", apply("doc.text", "gone").alias("cut"))
    return done.withColumn("cut", F.col("cut").withField("text", F.when(F.col("doc.text").isNotNull(), F.col("cut.text"))))


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row."""
    return _deduplicated(docs).select("doc.doc_id", "cut.n_lines", "cut.n_removed", "cut.text")


def without_repeats(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """Every row of ``docs``, all columns, with repeated lines cut out of its text; if not
    ``keep_emptied``, without the rows that lost all their lines."""
    done = _deduplicated(docs)
    if not keep_emptied:
        done = done.filter((F.col("cut.n_removed") == 0) | (F.col("cut.n_removed") < F.col("cut.n_lines")))
    new = {"text": F.col("cut.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut.text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
