"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stopping test.

1. Vectors are projected on ``PROJECTED`` Gaussian (2-stable) directions.  For two vectors at
   distance d, (projected distance / d)^2 is chi-square distributed with ``PROJECTED`` degrees
   of freedom.  Equal vectors are one class; a class needs only its smallest ids.
2. The projected space is cut into cells by a kd-tree over a bounded sample of projections
   (``SAMPLE``); every class goes to its cell, and cells of more than ``SHARD`` classes are dealt
   over several shards.  Each shard builds its own kd-tree when it is searched.
3. A search takes projected neighbours in increasing order, verifies them by their true
   distance, and stops as soon as the next projected distance D and the k-th best true distance
   d satisfy  chi-square(D^2 / d^2) >= ``CONFIDENCE``: a neighbour nearer than d would have been met
   with that probability, which is the expected recall.
4. Queries are first searched in their own shard; d then bounds the search in all
   other shards whose cell's box the test does not rule out.  Queries travel in blocks of at
   most ``BLOCK``, so that a task holds one shard and one block.

Nearness is Euclidean distance in double precision on the original vectors; ties go to
the smaller vec_id.

Results for odd input: vectors that are null, empty, all zero, or hold null or non-finite entries
take no part; vectors of unequal lengths are filled up with zeros; repeated rows are rows,
and all rows with the query's own vec_id are its own; rows without vec_id are no queries, and
rank last among ties; with fewer candidates than k all are returned; an empty table gives
no rows; a distance beyond double range is infinite.
"""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.vectors import filled, finite, matrix
from vantage.session import written

K, EVERY = 10, 100
#: Projected dimensions (even), probability of the stopping test, seed of the directions.
PROJECTED, CONFIDENCE, SEED = 8, 0.97, 7
#: Classes of a shard, queries of a block, points of a kd-tree's leaf, candidates verified between two tests.
SHARD, BLOCK, LEAF, STEP = 8192, 8192, 64, 256
#: Projections that the cells are fitted on, and least number of them in a cell.
SAMPLE, CELL_SAMPLE = 65536, 32
#: Copies of a query class's answers (one class may have most queries).
SALTS = 16
_LAST = 2**63 - 1


def chi_square(x: float, m: int = PROJECTED) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def quantile(p: float, m: int = PROJECTED) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTED))


class Cells:
    """A kd-tree as lists: a node is (axis, cut, left, right); a leaf is its cell, written as -1 - cell."""

    def __init__(self, points: np.ndarray, least: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.count = 0
        self.members: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), least)

    def _grow(self, points: np.ndarray, rows: np.ndarray, least: int) -> int:
        part = points[rows]
        axis = int(np.ptp(part, axis=0).argmax()) if len(rows) else 0
        cut = float(np.median(part[:, axis])) if len(rows) else 0.0
        over = part[:, axis] > cut
        if len(rows) < 2 * least or not over.any():
            self.count += 1
            self.members.append(rows)
            return -self.count
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        left, right = self._grow(points, rows[~over], least), self._grow(points, rows[over], least)
        self.nodes[at] = (axis, cut, left, right)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
                continue
            axis, cut, left, right = self.nodes[at]
            over = points[rows, axis] > cut
            todo += [(left, rows[~over]), (right, rows[over])]
        return out


def outside(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from ``point`` to boxes."""
    gap = np.maximum(0, np.maximum(low - point, point - high))
    return (gap * gap).sum(axis=1)


class Shard:
    """Classes of one shard under a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, n_ids: np.ndarray, first_id: np.ndarray):
        tree = Cells(projected, LEAF // 2)
        order = np.concatenate(tree.members)
        self.order, self.vectors, self.projected = order, vectors[order], projected[order]
        self.n_ids, self.first_id = n_ids[order], first_id[order]
        self.starts = np.cumsum([0] + [len(m) for m in tree.members])
        self.low = np.array([projected[m].min(axis=0) for m in tree.members])
        self.high = np.array([projected[m].max(axis=0) for m in tree.members])

    def nearest(self, vector: np.ndarray, point: np.ndarray, k: int, limit: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the classes that hold the k nearest ids and no farther one than ``bound``."""
        box = outside(self.low, self.high, point)
        leaves = np.argsort(box, kind="stable")
        frontier = np.append(box[leaves], np.inf)
        rows, distances = np.zeros(0, np.int64), np.zeros(0)
        waiting, ahead = np.zeros(0, np.int64), np.zeros(0)
        kth, at, take = bound, 0, 1
        while True:
            reach = limit * kth * kth  # projected neighbours beyond it end the search
            at_end = at >= len(leaves) or frontier[at] > reach
            if not at_end:  # open more leaves
                opened = leaves[at : at + take]
                new = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in opened])
                gap = self.projected[new] - point
                waiting, ahead = np.append(waiting, new), np.append(ahead, (gap * gap).sum(axis=1))
                at, take = at + take, take * 2
            ready = ahead <= (frontier[min(at, len(leaves))] if not at_end else np.inf)
            now = np.flatnonzero(ready)
            now = now[np.argsort(ahead[now], kind="stable")]
            for s in range(0, len(now), STEP):
                piece = now[s : s + STEP]
                piece = piece[ahead[piece] <= limit * kth * kth]
                if not len(piece):
                    break
                at_rows = waiting[piece]
                gap = self.vectors[at_rows] - vector
                true = np.sqrt((gap * gap).sum(axis=1))
                near = true <= kth
                rows, distances = np.append(rows, at_rows[near]), np.append(distances, true[near])
                best = np.lexsort((self.first_id[rows], distances))
                have = np.cumsum(self.n_ids[rows[best]])
                enough = int(np.searchsorted(have, k)) + 1
                rows, distances = rows[best[:enough]], distances[best[:enough]]
                if enough <= len(have):
                    kth = min(bound, float(distances[-1]))
            waiting, ahead = waiting[~ready], ahead[~ready]
            if at_end:
                return rows, distances


_FOUND = "qid long, cid long, score double, n_ids int, first_id long"


def searcher(k: int, limit: float):
    """Pandas function of (points of a shard, queries of a block)."""
    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if not len(points) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
        points = points.sort_values("cid")
        shard = Shard(np.vstack(points.v.to_numpy()), np.vstack(points.p.to_numpy()), points.n_ids.to_numpy(), points.first_id.to_numpy())
        cid, out = points.cid.to_numpy()[shard.order], []
        for query, v, p, bound in zip(queries.qid, queries.v, queries.p, queries.bound, strict=True):
            rows, distances = shard.nearest(v, p, k, limit, bound)
            out.append((np.full(len(rows), query), cid[rows], distances, shard.n_ids[rows], shard.first_id[rows]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(names)})

    return search


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k smallest ids; a class of very many rows is cut before the shuffle."""
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    return (rows.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k)
            .groupBy("v").agg(F.sort_array(F.collect_set(F.struct("r", "vec_id"))).alias("ids")))


def placed(classes: DataFrame, dim: int, cells: Cells | None) -> DataFrame:
    """``classes`` (cid, v, ...) with projections ``p`` and ``cell``."""
    sent = classes.sparkSession.sparkContext.broadcast((directions(dim), cells))  # at most SAMPLE / CELL_SAMPLE cells

    def project(batches):
        to, cells = sent.value
        for b in batches:
            p = matrix(b.column("v"), dim, float) @ to
            cell = cells.cell_of(p) if cells else np.zeros(len(p), np.int64)
            ends = np.arange(0, p.size + 1, PROJECTED, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel())), pa.array(cell, pa.int32())],
                [*b.schema.names, "p", "cell"])

    spec = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return classes.mapInArrow(project, f"{spec}, p array<double>, cell int")


def cut_into_cells(classes: DataFrame, dim: int, n: int) -> Cells:
    """Cells fitted on a sample: all classes, or about ``SAMPLE`` of them chosen by a hash."""
    some = classes.select("v")
    if n > SAMPLE:
        some = some.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < F.lit(int((1 << 40) * SAMPLE / n)))
    got = placed(some, dim, None).select("p").toPandas()
    points = np.vstack(got.p.to_numpy())
    return Cells(points[np.lexsort(points.T)], max(CELL_SAMPLE, ceil(SHARD * len(points) / n / 2)))


def blocks_of(cells: list) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of the queries of each cell: neighbouring cells share a block of
    at most BLOCK queries, a cell of more has blocks of its own."""
    out, block, held = {}, 0, 0
    for c in sorted(cells, key=lambda c: c["cell"]):
        q = c["queries"]
        if held and held + q > BLOCK:
            block, held = block + 1, 0
        many = max(1, ceil(q / BLOCK))
        out[c["cell"]] = (block, many)
        block, held = (block + many, 0) if many > 1 else (block, held + q)
    return out


def nearest_classes(points: DataFrame, dim: int, k: int, confidence: float) -> DataFrame:
    """``_FOUND``: for each class of ``points`` (cid, v, n_ids, first_id, asked) that is asked, the
    classes that hold its k nearest ids, itself included."""
    spark = points.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    limit = quantile(confidence)
    points = placed(points, dim, cut_into_cells(points, dim, n))
    sides = [f(F.get("p", F.lit(i))).alias(f"{s}{i}") for s, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("queries"), *sides).collect()
    blocks = blocks_of(cells)
    facts = [(c["cell"], ceil(c["n"] / SHARD), *blocks[c["cell"]], [c[f"low{i}"] for i in range(PROJECTED)],
              [c[f"high{i}"] for i in range(PROJECTED)]) for c in cells]  # at most SAMPLE / CELL_SAMPLE cells
    known = F.broadcast(spark.createDataFrame([f[:4] for f in facts], "cell int, shards int, first int, many int"))
    mark = F.xxhash64("v")
    points = written(points.join(known, "cell").select(
        "cid", "v", "p", "n_ids", "first_id", "asked", "cell", F.pmod(mark, "shards").cast("int").alias("shard"),
        (F.col("first") + F.pmod(F.shiftright(mark, 20), "many")).cast("int").alias("block")))
    queries = points.filter("asked").select(F.col("cid").alias("qid"), "v", "p", "cell", "shard", "block")
    search, columns = searcher(k, limit), ["cid", "v", "p", "n_ids", "first_id", "cell", "shard"]
    own = queries.withColumn("bound", F.lit(float("inf")))
    home = written(points.select(*columns).groupBy("cell", "shard").cogroup(own.groupBy("cell", "shard")).applyInPandas(search, _FOUND))
    # the k-th distance at home, where there are k ids
    ranked = home.withColumn("have", F.sum("n_ids").over(Window.partitionBy("qid").orderBy("score", "first_id", "cid")))
    bound = ranked.filter(F.col("have") >= k).groupBy("qid").agg(F.min("score").alias("bound"))
    boxes = spark.sparkContext.broadcast((np.array([f[0] for f in facts]), np.array([f[1] for f in facts]),
                                          np.array([f[4] for f in facts]), np.array([f[5] for f in facts])))

    def visits(batches):
        cell, shards, low, high = boxes.value
        for pdf in batches:
            out = []
            for i, (p, bound, c, s) in enumerate(zip(pdf.p, pdf.bound, pdf.cell, pdf.shard, strict=True)):
                hit = np.flatnonzero(outside(low, high, p) <= limit * bound * bound)
                where = np.repeat(cell[hit], shards[hit])
                which = np.concatenate([np.arange(m) for m in shards[hit]]) if len(hit) else where
                other = (where != c) | (which != s)
                out.append(pd.DataFrame({"row": i, "cell": where[other], "shard": which[other]}))
                if len(out) == 64 or i == len(pdf) - 1:
                    to = pd.concat(out)
                    part = pdf.iloc[to.pop("row").to_numpy()][["qid", "v", "p", "bound", "block"]].reset_index(drop=True)
                    yield pd.concat([part, to.reset_index(drop=True)], axis=1)
                    out = []

    asked = queries.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    sent = written(asked.mapInPandas(visits, "qid long, v array<double>, p array<double>, bound double, block int, cell int, shard int"))
    pairs = sent.select("cell", "shard", F.col("block").alias("block")).distinct()
    dealt = points.select(*columns).join(pairs, ["cell", "shard"])  # a shard once for each block that visits it
    keys = ["cell", "shard", "block"]
    away = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, _FOUND)
    return home.unionByName(away)


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id ``every`` divides."""
    rows, dim = filled(finite(embeddings, "vec_id").filter(F.exists("v", lambda x: x != 0)))
    more = k + 1  # the query itself may be among them
    classes = classes_of(rows, more)
    asked = rows.filter(F.col("vec_id") % every == 0)
    first = F.coalesce(F.get("ids", F.lit(0))["vec_id"], F.lit(_LAST))
    flags = asked.select("v").distinct().withColumn("asked", F.lit(True))
    classes = written(classes.join(flags, "v", "left").select(
        F.monotonically_increasing_id().alias("cid"), "v", "ids", F.size("ids").alias("n_ids"), first.alias("first_id"),
        F.coalesce("asked", F.lit(False)).alias("asked")))
    found = nearest_classes(classes.drop("ids"), dim, more, confidence)
    best = Window.partitionBy("qid").orderBy("score", "first_id", "cid")
    found = (found.withColumn("before", F.sum("n_ids").over(best) - F.col("n_ids")).filter(F.col("before") < more)
             .select("qid", "cid", "score"))
    members = classes.select("cid", F.explode("ids").alias("m")).select("cid", F.col("m.vec_id").alias("vec_id"))
    near = found.join(members, "cid").select("qid", "vec_id", "score", (F.col("cid") == F.col("qid")).alias("same"))
    order = Window.partitionBy("qid").orderBy("score", F.col("vec_id").asc_nulls_last())
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= more)
    answers = near.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("near"))
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    names = classes.filter("asked").select("v", F.col("cid").alias("qid"))
    one = asked.select(F.col("vec_id").alias("query_id"), "v").join(names, "v").select("query_id", "qid")
    one = one.distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    others = F.filter("near", lambda s: ~(s["same"] & s["vec_id"].eqNullSafe(F.col("query_id"))))
    return (one.join(salted, ["qid", "salt"])
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "s"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score")))
