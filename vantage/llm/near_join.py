"""N-gram Jaccard join by MinHash banding.

Two texts are linked if the Jaccard similarity of their sets of five-word runs is
at least ``THRESHOLD``.

1. A text becomes its set of run hashes, an exact digest of the set, and the
   hashes of ``bands`` bands of ``rows`` MinHash values; ``choose_bands`` takes the
   numbers for the target recall of a pair that just reaches the threshold.
2. Texts with equal sets are one *class*, named by its digest; only classes are
   compared, a class of any size at the price of one, by the text of one row.
3. Classes are shuffled on band hashes.  Buckets of one class are dropped, buckets
   with the same members are one.  Larger buckets that share a class are put
   together to one *cell*, so that their pairs are met once and not once a band;
   every other bucket is a cell of its own.
4. A cell of many classes is dealt out in tiles, pairs of blocks of bounded size.
   A tile holds the full sets of at most two blocks and verifies its pairs by set
   intersection.  A pair that shares several cells counts in the first one only.
   A tile returns a row for each class that has links: the documents it is linked
   with, and the smallest class connected to it inside the tile.  Pairs are not
   written out.
5. Link numbers are summed; ``components`` joins the tiles' connections to groups.

The work inside a group of n different near copies is still that of its n^2 / 2
comparisons, in tiles; exact copies cost nothing.

Results for odd input: a text of one to four words is one run of all its words;
null and empty texts, and texts without words, and rows without doc_id are linked
to nothing; rows with equal sets are linked with one another, whatever else
differs, and repeated rows count one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.components import components
from vantage.llm.text import lowered, mix, shingles, small_batches, words
from vantage.session import cut_lineage

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: MinHash values that banding may use.
VALUES = 128
#: Buckets of more classes than this share a cell with those they overlap.
LARGE = 8
#: Classes and bytes of a block; a tile holds two blocks.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_U = np.uint64


def choose_bands(threshold: float, recall: float, values: int = VALUES) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at ``threshold`` shares a band with
    probability ``recall``, with at most ``values`` MinHash values in all."""
    best = None
    for rows in range(1, values + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= values:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {values} values has a recall of {recall} at {threshold}")
    return best


def band_hashes(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band's MinHash values; bands have different hashes even for equal values."""
    k = np.arange(1, bands * rows + 1, dtype=_U)
    factor, shift = mix(k) | _U(1), mix(k + _U(1 << 32))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(sets), 4096):
        least = np.minimum(least, (sets[i : i + 4096, None] * factor + shift).min(axis=0))
    weight = mix(np.arange(1, rows + 1, dtype=_U)) | _U(1)
    return mix((mix(least).reshape(bands, rows) * weight).sum(axis=1, dtype=_U) + np.arange(1, bands + 1, dtype=_U))


def digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.astype("<u8").tobytes(), digest_size=16).digest()


def text_set(text: str | None) -> np.ndarray:
    return shingles(words(lowered(text))[2], SHINGLE)


def class_rows(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (runs), digest, bands of every row; no digest for rows that can have no links."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n int, digest binary, bands array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                s = text_set(t)
                out.append((len(s), digest(s), band_hashes(s, bands, rows).view(np.int64)) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n", "digest", "bands"])

    text = F.when(F.col("doc_id").isNotNull(), F.col("text"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), describe(F.coalesce(text, F.lit(""))).alias("d"))
            .select("doc_id", "mark", "d.n", "d.digest", "d.bands"))


def cells(classes: DataFrame) -> DataFrame:
    """(id, cells): the cells of each class that has any; a cell is (name, number of blocks)."""
    placed = classes.select("id", "n", F.explode("bands").alias("key"))
    size = placed.groupBy("key").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    # buckets with the same members are one
    buckets = size.filter("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    member = cut_lineage(placed.join(buckets, "key").select("id", "n", "key", "m"))
    large = member.filter(F.col("m") > LARGE)
    star = large.select(F.col("key").alias("u"), F.min("key").over(_by_id()).alias("v"))
    root = components(star).withColumnRenamed("node", "key")
    named = member.join(root, "key", "left").select("id", "n", F.coalesce("root", "key").alias("cell")).distinct()
    blocks = named.groupBy("cell").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n").cast("long")) * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    return named.join(blocks, "cell").groupBy("id").agg(F.collect_list(F.struct("cell", "blocks")).alias("cells"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")  # at most one row for each band


_TILE = "cell long, a int, b int, id binary, block int, size long, others array<long>, sets binary"


def tile_rows(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The members of every tile with their full sets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for r in pdf.itertuples():
                s = text_set(r.text)
                data, names = s.astype("<u8").tobytes(), sorted(c["cell"] for c in r.cells)
                for c in r.cells:
                    n = c["blocks"]
                    own = int.from_bytes(r.id[:8], "little") % n
                    for other in range(n):
                        out.append((c["cell"], min(own, other), max(own, other), r.id, own, r.size, names, data))
                        held += len(data)
                        if held > BLOCK_BYTES:
                            yield pd.DataFrame(out, columns=[x.split()[0] for x in _TILE.split(", ")])
                            out, held = [], 0
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _TILE.split(", ")])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    # repeated rows stand together already: one of them stays
    one = text.join(placed, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(
        *[F.first(c).alias(c) for c in ("text", "id", "size", "cells")])
    return one.select("id", "size", "cells", "text").mapInPandas(rows, _TILE)


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Similarity of all pairs, from shared elements counted in slices of a 0/1 matrix."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1  # elements of one set only share nothing
    row, column = row[common], column[common]
    column = np.cumsum(np.diff(column, prepend=-1) > 0) - 1 if len(column) else column
    shared = np.zeros((n, n), np.float32)
    width = max(1, (1 << 21) // n)
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        shared += part @ part.T
    return shared / (size[:, None] + size[None, :] - shared)


def judge(cell: int, one_block: bool, ids: list[bytes], block: np.ndarray, size: np.ndarray, others: list,
          sets: list[np.ndarray], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(class, documents linked, one class connected) of one tile's members that have links;
    classes of one connected part name the same one."""
    linked = jaccard(sets) >= threshold - 1e-6
    np.fill_diagonal(linked, False)
    if not one_block:  # pairs inside a block belong to the block's own tile
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return []
    counted = linked.copy()
    for c in {c for o in others for c in o if c < cell}:  # pairs met in an earlier cell
        has = np.array([c in o for o in others])
        counted &= ~(has[:, None] & has[None, :])
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    n = (counted * size[None, :]).sum(axis=1)
    return [(ids[i], int(n[i]), ids[root[i]]) for i in np.flatnonzero(linked.any(axis=1))]


def verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) from every tile; the rows of a tile stand together in one sorted partition."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> list:
            if len(held) < 2:
                return []
            return judge(now[0], now[1] == now[2], [r.id for r in held], np.array([r.block for r in held]),
                         np.array([r.size for r in held]), [set(r.others) for r in held],
                         [np.frombuffer(r.sets, "<u8") for r in held], threshold)

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if (r.cell, r.a, r.b) != now:
                    out += done()
                    now, held = (r.cell, r.a, r.b), []
                held.append(r)
            yield pd.DataFrame(out, columns=["id", "links", "root"])
        yield pd.DataFrame(done(), columns=["id", "links", "root"])

    return (tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
            .mapInPandas(rows, "id binary, links long, root binary"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described, classes, linked): doc_id, mark and digest of each row; digest, doc_id (the
    smallest) and size of each class; digest, links (documents of other classes) and root
    (smallest doc_id of all classes connected) of each linked class."""
    bands, rows = choose_bands(threshold, recall)
    described = cut_lineage(class_rows(docs, bands, rows))
    classes = described.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("size"),
                                              F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.select(F.col("digest").alias("id"), "least.doc_id", "least.mark", "size", "n", "bands"))
    placed = cells(classes.select("id", "n", "bands"))
    placed = placed.join(classes.select("id", "doc_id", "mark", "size"), "id")
    found = cut_lineage(verified(tile_rows(docs, placed), threshold))
    root = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("id"), "root")
    least = root.join(classes, "id").groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(root.join(least, "root"), "id")
    return (described.select("doc_id", "mark", "digest"), classes.select(F.col("id").alias("digest"), "doc_id", "size"),
            linked.select(F.col("id").alias("digest"), "links", F.col("least").alias("root")))


def near_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of all texts connected by links),
    copy_id (smallest doc_id with the same set of runs), n_links (documents linked to this one)."""
    described, classes, linked = near_groups(docs, threshold, recall)
    known = (classes.join(linked, "digest", "left")
             .select("digest", F.coalesce("root", "doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
                     (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return described.join(known, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a document of a smaller doc_id
    (through any number of links); rows that share the kept doc_id stay together, and of rows with
    one doc_id and several texts each goes or stays by its own text."""
    described, classes, linked = near_groups(docs, threshold, recall)
    classes = classes.withColumnRenamed("doc_id", "least")
    gone = (described.join(classes, "digest").join(linked, "digest", "left")
            .filter(F.col("doc_id") != F.coalesce("root", "least"))
            .select(F.col("doc_id").alias("gone"), "mark").distinct())
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), F.struct("*").alias("doc"))
    kept = rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("own") == F.col("mark")), "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
