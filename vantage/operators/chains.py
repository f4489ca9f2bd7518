"""Greedy gap chains without per-key folds (W9, and the window starts of U10).

Greedy rule: per key, the first event is kept; after a kept event at time t the
next kept one is the first event at or after t + gap.  Sequential by nature,
but it is a path in the forest of "next" pointers:

1. ``next(i)`` = first event of the key with time >= t_i + gap.  Events are
   bucketed by ``b = floor(t / gap)``.  The target lies in bucket b+1, or is the
   first event of bucket b+2; any later one stands behind an empty bucket and is a
   head (below), so it needs no pointer.  One window per (key, bucket) over the
   bucket's events, the probes from the bucket before and the first event of the
   bucket after finds all targets: a hot key is spread over time.
2. A head is an event at least one gap behind the one before it: always kept.
   It is the first event of its bucket, with no probe after it.
3. The kept events are ``head, next(head), next(next(head)), ...``: pointer
   doubling extends the kept set by jumps of 1, 2, 4, ... nodes per round, so
   the rounds are the log2 of the longest chain between two heads.  A round is
   one join and one aggregate, written as a table into the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vantage.operators.windows import interval_us
from vantage.session import written


def _node(keys: Sequence[str]) -> F.Column:
    return F.struct(*[F.col(k) for k in keys], F.col("_t").alias("_t"), F.col("_s").alias("_s"))


def next_pointers(df: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """(node, nxt, head): nxt = first node with time >= t + gap, NULL where there
    is none before the next head; head = no row less than one gap before."""
    keys = list(keys)
    d = df.withColumn("_b", F.floor(F.col("_t") / F.lit(gap_us)).cast("long")).withColumn("node", _node(keys))
    none = F.lit(None).cast(d.schema["node"].dataType)
    # at equal times a probe sorts before the events, so ">=" includes them
    own = d.select(*keys, "_b", F.col("_t").alias("_time"), F.col("_s").alias("_ord"), F.lit(1).alias("_kind"),
                   F.col("node").alias("_event"), none.alias("_probe"))
    probes = d.select(*keys, (F.col("_b") + 1).alias("_b"), (F.col("_t") + gap_us).alias("_time"), F.col("_s").alias("_ord"),
                      F.lit(0).alias("_kind"), none.alias("_event"), F.col("node").alias("_probe"))
    firsts = (d.groupBy(*keys, "_b").agg(F.min("node").alias("_event"))
              .select(*keys, (F.col("_b") - 1).alias("_b"), F.col("_event._t").alias("_time"),
                      F.col("_event._s").alias("_ord"), F.lit(2).alias("_kind"), "_event", none.alias("_probe")))
    # latest first, so that "what comes after" is a running frame
    part = Window.partitionBy(*keys, "_b")
    after = (part.orderBy(F.col("_time").desc(), F.col("_kind").desc(), F.col("_ord").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    is_own, is_probe = F.col("_kind") == 1, F.col("_kind") == 0
    seen = (own.unionByName(probes).unionByName(firsts)
            .withColumn("_hit", F.last("_event", ignorenulls=True).over(after))
            .withColumn("_head", (F.col("_event") == F.min(F.when(is_own, F.col("_event"))).over(part))
                        & (F.coalesce(F.count_if(is_probe).over(after), F.lit(0)) == 0)))
    # a node appears as an event (is it a head?) and as a probe (what is next?)
    return (seen.filter(is_own | is_probe)
            .groupBy(F.coalesce("_event", "_probe").alias("node"))
            .agg(F.max(F.when(is_probe, F.col("_hit"))).alias("nxt"), F.max(F.when(is_own, F.col("_head"))).alias("head")))


def _write_path(path: DataFrame) -> tuple[DataFrame, int]:
    """(a, b, kept) as a written table, and the number of kept nodes that still point on."""
    seen = Observation()
    table = written(path.observe(seen, F.count_if(F.col("kept") & F.col("b").isNotNull()).alias("open")))
    return table, seen.get["open"]


def greedy_chain(df: DataFrame, keys: Sequence[str], ts_col: str, seq_col: str | None, gap: str,
                 out_col: str = "kept", max_rounds: int = 64) -> DataFrame:
    """Adds ``out_col``: whether the row is kept by the greedy gap rule
    (order by ts, then seq; rows must be unique on keys + ts + seq)."""
    keys = list(keys)
    gap_us = interval_us(gap)
    seq = F.col(seq_col).cast("long") if seq_col else F.lit(0).cast("long")
    # written once: the rows are read three times below
    base = written(df.withColumn("_t", F.unix_micros(F.col(ts_col))).withColumn("_s", seq))
    path, open_ends = _write_path(next_pointers(base.select(*keys, "_t", "_s"), keys, gap_us)
                                  .select(F.col("node").alias("a"), F.col("nxt").alias("b"), F.col("head").alias("kept")))
    rounds = 0
    while open_ends:
        if rounds == max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        rounds += 1
        # twice as far: a -> b -> b's target, but no further than a node that is kept already, whose
        # own chain covers the rest; what a kept node points at is kept
        target = path.select(F.col("a").alias("b"), F.col("b").alias("_far"), F.col("kept").alias("_passed"))
        further = path.join(target, "b", "left").select("a", F.when(~F.col("_passed"), F.col("_far")).alias("b"), "kept")
        reached = path.filter("kept AND b IS NOT NULL").select(
            F.col("b").alias("a"), F.lit(None).cast(path.schema["b"].dataType).alias("b"), F.lit(True).alias("kept"))
        path, open_ends = _write_path(further.unionByName(reached).groupBy("a")
                                      .agg(F.max("b").alias("b"), F.max("kept").alias("kept")))
    flagged = path.filter("kept").select(F.col("a").alias("node"), F.lit(True).alias(out_col))
    return (base.withColumn("node", _node(keys)).join(flagged, "node", "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(False)))
            .drop("node", "_t", "_s"))
