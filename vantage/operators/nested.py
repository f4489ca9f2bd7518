"""Nested results in chunks (N3): a waterfall {spans, lanes, summary}, a compute chain {nodes, edges, summary}.

A recording may hold any number of spans, so it never becomes one row: its spans are cut
into chunks by position, each an array of at most ``size`` structs.  Parts that
belong to a span or node lie in its chunk, and the summary is in chunk 0 only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators.compute import Chain, Part

CHUNK = 500


def in_chunks(rows: DataFrame, keys: Sequence[str], pos: Column, fields: Sequence[str], out_col: str,
              size: int = CHUNK) -> DataFrame:
    """(keys, chunk, out_col): the structs of ``fields`` of a chunk, sorted by ``pos`` and then by the
    fields in order.  ``pos`` counts from 0 within the keys; chunk = pos div size."""
    at = pos.cast("long")
    item = F.struct(at.alias("_at"), *[F.col(f) for f in fields])
    packed = (rows.withColumn("chunk", F.floor(at / F.lit(size)).cast("long"))
              .groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(item)).alias(out_col)))
    return packed.withColumn(out_col, F.transform(out_col, lambda x: x.dropFields("_at")))


def nested_result(base: DataFrame, parts: Sequence[DataFrame], summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks of ``base`` with the arrays of ``parts`` (NULL where a chunk has none) and, in
    chunk 0, the row of ``summary`` as a struct."""
    keys = list(keys)
    out = base
    for p in parts:
        out = out.join(p, [*keys, "chunk"], "left")
    fields = [c for c in summary.columns if c not in keys]
    once = summary.select(*keys, F.lit(0).cast("long").alias("chunk"), F.struct(*fields).alias("summary"))
    return out.join(once, [*keys, "chunk"], "left")


def waterfall_documents(spans: DataFrame, lanes: DataFrame, summary: DataFrame, keys: Sequence[str],
                        size: int = CHUNK) -> DataFrame:
    """(keys, chunk, spans, lanes, summary).  Every recording with a span has a chunk 0, and it
    has at most as many lanes as spans, so no lane is without a chunk."""
    keys = list(keys)

    def packed(df, name, skip=()):
        return in_chunks(df, keys, F.col("pos"), [c for c in df.columns if c not in (*keys, "pos", *skip)], name, size)

    return nested_result(packed(spans, "spans", ("full_sql",)), [packed(lanes, "lanes")], summary, keys)


def _end(dst: Column) -> Column:
    return F.regexp_extract(dst, r"(\d+)$", 1).cast("long")  # node ids end in the node's position


def chain_documents(chain: DataFrame | Chain, edges: DataFrame | Part, stats: DataFrame | Part, size: int = CHUNK) -> DataFrame:
    """(rec, chunk, nodes, edges, summary); an edge lies in the chunk of the node it ends in.

    The documents of a packed chain's short recordings are cut from their rows."""
    if isinstance(chain, Chain):
        short = _short_documents(chain.short.select("rec", "nodes", edges.short.alias("edges"), stats.short.alias("summary")), size)
        return short if chain.long is None else short.unionByName(chain_documents(chain.long, edges.long, stats.long, size))
    nodes = in_chunks(chain, ["rec"], F.col("idx"), [c for c in chain.columns if c not in ("rec", "idx")], "nodes", size)
    ends = in_chunks(edges, ["rec"], _end(F.col("dst")), ["kind", "src", "dst", "trigger_field"], "edges", size)
    return nested_result(nodes, [ends], stats, ["rec"])


def _short_documents(rows: DataFrame, size: int) -> DataFrame:
    def chunk_of(at: Column) -> Column:
        return F.floor(at.cast("long") / F.lit(size)).cast("long")

    chunk = F.col("chunk")
    nodes = F.transform(F.filter("nodes", lambda n: chunk_of(n["idx"]).eqNullSafe(chunk)), lambda n: n.dropFields("idx"))
    ends = F.transform(F.filter("edges", lambda e: chunk_of(_end(e["dst"])) == chunk), lambda e: F.struct(
        _end(e["dst"]).alias("_at"), *[e[c].alias(c) for c in ("kind", "src", "dst", "trigger_field")]))
    edges = F.transform(F.sort_array(ends), lambda e: e.dropFields("_at"))
    cut = rows.select("rec", F.explode(F.array_distinct(F.transform("nodes", lambda n: chunk_of(n["idx"])))).alias("chunk"), "nodes", "edges", "summary")
    cut = cut.select("rec", "chunk", nodes.alias("nodes"), edges.alias("edges"), F.when(F.col("rec").isNotNull() & (chunk == 0), F.col("summary")).alias("summary"))
    return cut.withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")))
