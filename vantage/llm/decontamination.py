"""Benchmark decontamination with an FM-index per training shard.

Windows of ``WINDOW`` consecutive words are taken from every benchmark item (an
item with fewer words, but not none, is one window) and searched in the words of
all documents.

* A shard is some consecutive documents of a partition.  Only runs of words that
  occur in the benchmark can hold a window, and only runs as long as the shortest
  window; the shard's string is made of these runs with separators between them.
* Its suffix array is built by prefix doubling, its Burrows-Wheeler transform is
  kept as a wavelet matrix, and all windows are searched backwards together, one
  rank per letter and level.
* Occurrences are located through every ``SAMPLE``-th suffix position: a row that
  has none walks back letter by letter until it meets one.
* Located windows are merged into spans of hit words.

Words are compared by 64-bit hashes of their bytes.  The benchmark is the stated
query set: it is read in blocks of at most ``BLOCK_BYTES`` of text, each sent to
the tasks as one small table of window hashes; spans of several blocks are merged
per document.

Results for odd input: null and empty texts have no words; items without words
are no windows; an item_id that occurs twice counts once; windows of items
without item_id hit words, but such items are not listed; repeated rows are
judged one by one; other columns are carried along, whatever their names.  Texts
are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.text import lowered, small_batches, words

WINDOW = 10
SAMPLE = 16
#: Text bytes of the benchmark that are searched in one pass over the documents.
BLOCK_BYTES = 16 << 20
#: A shard ends at so many indexed words, or so many bytes of text.
SHARD_WORDS, SHARD_BYTES = 1 << 19, 8 << 20


class Wavelet:
    """Wavelet matrix over small integers: rank of a letter, and the letter at a place."""

    def __init__(self, letters: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.split = [], []
        for level in reversed(range(self.bits)):
            zero = (letters >> level) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            letters = np.concatenate([letters[zero], letters[~zero]])

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``letter`` stands before ``at``."""
        base = np.zeros_like(at)
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (letter >> (self.bits - 1 - k)) & 1 == 1
            at = np.where(one, split + at - zeros[at], zeros[at])
            base = np.where(one, split + base - zeros[base], zeros[base])
        return at - base

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letter at ``at``, how often it stands before)."""
        letter, base = np.zeros_like(at), np.zeros_like(at)
        for zeros, split in zip(self.zeros, self.split, strict=True):
            one = zeros[at + 1] == zeros[at]
            letter = letter * 2 + one
            at, base = (np.where(one, split + x - zeros[x], zeros[x]) for x in (at, base))
        return letter, at - base


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length until all differ."""
    n = len(letters)
    rank, size = letters.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.empty(n, np.int64)
        behind = np.zeros(n, np.int64)
        if size > 1:
            behind[: n - size // 2] = rank[size // 2 :] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key, kind="stable")
        else:
            key = rank
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = new
        if rank.max(initial=0) == n - 1 or size >= 2 * n:
            return order
        size *= 2


class FMIndex:
    """Backward search over ``letters`` (0 to sigma-1); an own least letter ends the string."""

    def __init__(self, letters: np.ndarray, sigma: int):
        text = np.append(letters + 1, 0)
        order = suffix_array(text)
        self.wavelet = Wavelet(text[order - 1], sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.marked = order % SAMPLE == 0
        self.sampled = order[self.marked]
        self.place = np.cumsum(self.marked) - 1
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (its first ``lengths`` letters)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for i in reversed(range(patterns.shape[1])):
            live = np.flatnonzero((i < lengths) & (low < high))
            letter = patterns[live, i] + 1
            low[live] = self.before[letter] + self.wavelet.rank(letter, low[live])
            high[live] = self.before[letter] + self.wavelet.rank(letter, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the string of each row."""
        out, walk, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            known = self.marked[rows]
            out[walk[known]] = self.sampled[self.place[rows[known]]] + steps
            rows, walk = rows[~known], walk[~known]
            letter, seen = self.wavelet.access(rows)
            rows = self.before[letter] + seen
            steps += 1
        return out


class Phrases:
    """The windows of some items: distinct word hashes, windows as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        rows: dict[bytes, set[str | None]] = {}
        for item, text in items:
            h = words(lowered(text))[2]
            for i in range(max(1, len(h) - WINDOW + 1) if len(h) else 0):
                rows.setdefault(h[i : i + WINDOW].tobytes(), set()).add(item)
        runs = [np.frombuffer(r, np.uint64) for r in rows]
        self.items = [sorted(i for i in s if i is not None) for s in rows.values()]
        self.lengths = np.array([len(r) for r in runs], np.int64)
        self.words = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        self.rows = np.zeros((len(runs), WINDOW), np.int64)
        for k, r in enumerate(runs):
            self.rows[k, : len(r)] = np.searchsorted(self.words, r) + 1  # 0 separates runs

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, 0 for words of no window."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


def _runs(number: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of at least ``least`` known words."""
    edge = np.diff((number > 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def search_shard(phrases: Phrases, numbers: list[np.ndarray]) -> list[tuple[np.ndarray, list[str]]]:
    """For each document of a shard: its hit words (sorted places) and the items found in it."""
    hits: list[list[np.ndarray]] = [[] for _ in numbers]
    items: list[set[str]] = [set() for _ in numbers]
    least = int(phrases.lengths.min(initial=WINDOW))
    found = [(d, a, b) for d, n in enumerate(numbers) for a, b in (_runs(n, least) if len(phrases.rows) else ())]
    if found:
        parts = [x for d, a, b in found for x in (numbers[d][a:b], [0])]
        index = FMIndex(np.concatenate(parts).astype(np.int64), len(phrases.words) + 1)
        low, high = index.search(phrases.rows, phrases.lengths)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = index.locate(rows)
        begin = np.cumsum([0, *(b - a + 1 for _, a, b in found)])[:-1]
        run = np.searchsorted(begin, at, side="right") - 1
        for p, r, place in zip(which.tolist(), run.tolist(), (at - begin[run]).tolist(), strict=True):
            d, a, _ = found[r]
            hits[d].append(np.arange(a + place, a + place + phrases.lengths[p]))
            items[d].update(phrases.items[p])
    return [(np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64), sorted(i)) for h, i in zip(hits, items, strict=True)]


def _spans(start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """(byte start, byte end, words) of every run of hit words."""
    if not len(hit):
        return []
    first = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
    last = np.append(first[1:], len(hit)) - 1
    return list(zip(start[hit[first]].tolist(), end[hit[last]].tolist(), (last - first + 1).tolist(), strict=True))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded text size; a larger benchmark makes more blocks, not larger ones."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    for b in range(n):
        some = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in some.collect()]


_FOUND = "n_words long, spans array<struct<start:long, end:long, words:long>>, items array<string>"


def _search(docs: DataFrame, text: str, items: list[tuple[str | None, str | None]], keep: list[str]) -> DataFrame:
    """``docs`` (the columns ``keep``) with what one block of items hits in the column ``text``."""
    spark = docs.sparkSession
    phrases = spark.sparkContext.broadcast(Phrases(items))  # of at most BLOCK_BYTES of text

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = phrases.value
        for texts in batches:
            rows, shard, size, indexed = [], [], 0, 0

            def flush(shard=shard, rows=rows):
                for (n, s, e, _), (hit, found) in zip(shard, search_shard(p, [x[3] for x in shard]), strict=True):
                    rows.append((n, [dict(zip(("start", "end", "words"), x, strict=True)) for x in _spans(s, e, hit)], found))
                shard.clear()

            for t in texts:
                data = lowered(t)
                s, e, h = words(data)
                number = p.numbers(h) if len(p.words) else np.zeros(len(h), np.int64)
                shard.append((len(h), s, e, number))
                size += len(data)
                indexed += int((number > 0).sum())
                if size > SHARD_BYTES or indexed > SHARD_WORDS:
                    flush()
                    size = indexed = 0
            flush()
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return docs.select(*keep, search(F.coalesce(F.col(text), F.lit(""))).alias("found"))


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, found): every row as a struct, with its words, spans and items over all blocks."""
    small_batches(docs.sparkSession)
    out = docs.select(F.struct("*").alias("doc"))
    parts = list(blocks(benchmark))
    out = _search(out, "doc.text", parts[0], ["doc"])
    for items in parts[1:]:
        # the spans stay in their row: a further block adds to them, no shuffle
        out = _search(out, "doc.text", items, ["doc", F.col("found").alias("past")])
        out = out.select("doc", F.pandas_udf(_joined, _FOUND)("doc.text", "past", "found").alias("found"))
    return out


def _joined(texts: pd.Series, past: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """What two blocks found, as one list of disjoint spans."""
    spans = []
    for t, a, b in zip(texts, past["spans"], found["spans"], strict=True):
        if len(a) and len(b):
            start = words(lowered(t))[0]
            both = _merge([(x["start"], x["end"]) for x in (*a, *b)])
            spans.append([{"start": i, "end": j, "words": int(np.searchsorted(start, j) - np.searchsorted(start, i))}
                          for i, j in both])
        else:
            spans.append([*a, *b])
    items = [sorted({*a, *b}) for a, b in zip(past["items"], found["items"], strict=True)]
    return pd.DataFrame({"n_words": found["n_words"], "spans": spans, "items": items})


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is not None and len(s):
            raw, past, kept = t.encode("utf-8", "surrogatepass"), 0, []
            for x in s:
                kept.append(raw[past : x["start"]])
                past = x["end"]
            t = b"".join([*kept, raw[past:]]).decode("utf-8", "surrogatepass")
        out.append(t)
    return pd.Series(out, dtype=object)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    found = _found(docs, benchmark)
    return (found.select("doc.doc_id", "found.n_words", hit.alias("n_hit"),
                         F.size("found.items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs``, all columns, with the words of benchmark windows cut out of its text."""
    done = _found(docs, benchmark).select("doc", F.pandas_udf(_cut, "string")("doc.text", "found.spans").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
