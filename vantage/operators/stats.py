"""Windowed statistics.

Exact nearest-rank percentiles are computed from a per-group value histogram:
the raw rows are first reduced map-side to (group, value, count), then the value
at rank ``min(p*n div 100, n-1)`` is found by refining ranges of values, so that
no task sorts more than ``LEAF_VALUES`` values of a group.  ``window_stats`` keeps the
whole milliseconds of one short window, whose number of values is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scoring import ratio_hundredths
from vantage.session import written

LEAF_VALUES = 100_000  # distinct values of one group that one task sorts
RANGES = 1024          # sub-ranges that one round of refinement counts
SALTS = 16             # tasks that share the values of an open group


def _cols(xs: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in xs]


def nearest_rank_from_hist(hist: DataFrame, keys: Sequence[str], value_col: str,
                           count_col: str, p: int = 95, out_col: str = "p95", leaf: int = LEAF_VALUES) -> DataFrame:
    """Pick, per group, the value at zero-based rank ``min(p*n div 100, n-1)``
    from a histogram (keys, value, count).  Returns (keys, out_col).

    Range refinement: a group with more than ``leaf`` values is cut into ``RANGES``
    equal sub-ranges of its values, which are counted, and only the sub-range that
    holds the rank stays open, until it has at most ``leaf`` values.  Only then are
    the values of a group sorted in one task.  Every round that finds a group to open
    reads the open values once and writes those that stay open.
    """
    keys = list(keys)
    hist = hist.select(*keys, F.col(value_col).alias("_v"), F.col(count_col).alias("_c"))
    size = (hist.groupBy(*_cols(keys))
            .agg(F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    wide = (size.filter(F.col("_d") > leaf)
            .withColumn("_r", F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)))
    part = Window.partitionBy(*_cols(keys))
    if wide.isEmpty():
        return _value_at(hist.withColumn("_n", F.sum("_c").over(part))
                         .withColumn("_r", F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)), keys, out_col)
    wide = written(wide)
    found = _value_at(_of_groups(hist, wide, keys, "left_anti").withColumn("_n", F.sum("_c").over(part))
                      .withColumn("_r", F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)), keys, out_col)
    rows = hist
    while not wide.isEmpty():
        cut = _of_groups(rows, wide.select(*keys, "_lo", "_hi", "_r"), keys, "inner")
        v, lo, hi = (_spacious(cut, c) for c in ("_v", "_lo", "_hi"))
        share = (v - lo).cast("double") / (hi - lo).cast("double")
        # any cut that rises with the value is exact: ranges are counted as they are cut
        cut = written(cut.withColumn("_range", F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).drop("_lo", "_hi"))
        ranges = (cut.groupBy(*_cols(keys), F.col("_range"))
                  .agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"),
                       F.max("_v").alias("_hi"), F.first("_r").alias("_r")))
        upto = part.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # at most RANGES rows a group
        picked = (ranges.withColumn("_r", F.col("_r") - (F.sum("_n").over(upto) - F.col("_n")))
                  .filter((F.col("_r") >= 0) & (F.col("_r") < F.col("_n"))))
        picked = written(picked)
        rows = _of_groups(cut.drop("_r"), picked.select(*keys, "_range", "_d", "_r"), [*keys, "_range"], "inner").drop("_range")
        small = rows.filter(F.col("_d") <= leaf).drop("_d")
        found = found.unionByName(_value_at(small, keys, out_col))
        rows = written(rows.filter(F.col("_d") > leaf).drop("_d", "_r"))
        wide = picked.filter(F.col("_d") > leaf)
    return found


def _spacious(cut: DataFrame, name: str) -> Column:
    """A value in a type whose differences do not overflow."""
    kind = cut.schema[name].dataType.typeName()
    if kind in ("float", "double"):
        return F.col(name) * F.when(F.greatest(F.abs("_lo"), F.abs("_hi")) > 1e300, F.lit(0.5)).otherwise(F.lit(1.0))
    return F.col(name) if kind == "decimal" else F.col(name).cast("decimal(20,0)")


def _of_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined to the one row a group of ``groups``, a group dealt over ``SALTS`` tasks."""
    salted = (groups.select(*[F.col(k).alias("_k_" + k) for k in keys],
                            *[F.col(c) for c in groups.columns if c not in keys])
              .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    if how == "left_anti":
        salted = salted.select(*["_k_" + k for k in keys], "_s")
    on = F.pmod(F.xxhash64("_v"), F.lit(SALTS)) == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    return rows.join(salted, on, how).drop("_s", *["_k_" + k for k in keys])


def _value_at(hist: DataFrame, keys: Sequence[str], out_col: str) -> DataFrame:
    """(keys, value) of the value that holds rank ``_r`` among a group's few values."""
    upto = Window.partitionBy(*_cols(keys)).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.sum("_c").over(upto))
    return (h.filter((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
            .select(*_cols(keys), F.col("_v").alias(out_col)))


def nearest_rank(df: DataFrame, keys: Sequence[str], value_col: str, p: int = 95,
                 out_col: str = "p95", leaf: int = LEAF_VALUES) -> DataFrame:
    """Exact nearest-rank percentile ``sorted[min(p*n div 100, n-1)]``
    (zero-based) of the numbers ``value_col`` per group (NULL keys are a group);
    NULL and NaN values are left out; empty input -> no rows."""
    kept = F.col(value_col).isNotNull()
    if df.schema[value_col].dataType.typeName() in ("float", "double"):
        kept = kept & ~F.isnan(value_col)
    hist = df.filter(kept).groupBy(*_cols(keys), F.col(value_col)).agg(F.count(F.lit(1)).alias("_c"))
    return nearest_rank_from_hist(written(hist), keys, value_col, "_c", p, out_col, leaf)


def window_stats(events: DataFrame, window: str = "30 seconds",
                 keys: Sequence[str] = ("env_id",), group: Sequence[str] = ("model", "method"),
                 p: int = 95) -> DataFrame:
    """A7 (+A9, A10): per (keys, tumbling window, group) call_count, total_ms,
    avg_ms (2 dp), max_ms, p95_ms, n1_detected, sample_sql (first non-empty SQL
    in arrival order).  Rows whose group columns are all empty are excluded.

    Plan: one map-side-combined aggregate to (group, duration) histogram rows,
    then a window over each group's histogram and a final aggregate on the
    same partitioning (no further exchange).
    """
    keys, group = list(keys), list(group)
    gk = keys + ["period"] + group
    not_all_empty = F.lit(False)
    for g in group:
        not_all_empty = not_all_empty | (F.coalesce(F.col(g), F.lit("")) != "")
    ev = (events.filter(not_all_empty)
          .withColumn("period", F.window("ts", window).start))
    first_sql = F.min(F.when(F.coalesce(F.col("sql"), F.lit("")) != "",
                             F.struct(F.col("ts"), F.col("seq"), F.col("sql"))))
    hist = (ev.groupBy(*_cols(gk), F.col("duration_ms"))
            .agg(F.count(F.lit(1)).alias("_c"),
                 F.max(F.col("is_n1").cast("int")).alias("_n1"),
                 first_sql.alias("_first")))
    part = Window.partitionBy(*_cols(gk))
    cw = part.orderBy(F.col("duration_ms")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("_c").over(part)
    r = F.least(F.floor(n * p / 100), n - 1)
    h = hist.withColumn("_cum", F.sum("_c").over(cw)).withColumn("_r", r)
    is_pick = (F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum"))
    out = (h.groupBy(*_cols(gk))
           .agg(F.sum("_c").alias("call_count"),
                F.sum(F.col("duration_ms").cast("long") * F.col("_c")).alias("total_ms"),
                F.max("duration_ms").alias("max_ms"),
                F.max(F.when(is_pick, F.col("duration_ms"))).alias("p95_ms"),
                (F.max("_n1") == 1).alias("n1_detected"),
                F.min("_first").alias("_first")))
    return (out.withColumn("avg_ms", ratio_hundredths("total_ms", "call_count"))
            .withColumn("sample_sql", F.coalesce(F.col("_first.sql"), F.lit("")))
            .drop("_first"))


def batch_summary(events: DataFrame, window: str = "30 seconds", keys: Sequence[str] = ("env_id",),
                  slow_threshold_ms: int = 0) -> DataFrame:
    """Per (keys, window) totals over every event (key-less ones too):
    total_queries, total_duration_ms, slow_queries (duration > threshold when
    threshold > 0), n1_patterns (flagged events), errors."""
    slow = (F.col("duration_ms") > slow_threshold_ms) if slow_threshold_ms > 0 else F.lit(False)
    return (events.withColumn("period", F.window("ts", window).start)
            .groupBy(*_cols(keys), F.col("period"))
            .agg(F.count(F.lit(1)).alias("total_queries"),
                 F.sum(F.col("duration_ms").cast("long")).alias("total_duration_ms"),
                 F.count_if(slow).alias("slow_queries"),
                 F.count_if(F.col("is_n1")).alias("n1_patterns"),
                 F.count_if(F.col("is_error")).alias("errors")))


def stats_rollup(stats: DataFrame, keys: Sequence[str] = ("env_id", "model", "method")) -> DataFrame:
    """A4: rollup of window stats by (model, method): sums, peak, any N+1."""
    return (stats.groupBy(*_cols(keys))
            .agg(F.sum("call_count").alias("total_calls"),
                 F.sum("total_ms").alias("total_ms"),
                 F.max("max_ms").alias("peak_ms"),
                 F.bool_or("n1_detected").alias("any_n1"),
                 F.count(F.lit(1)).alias("windows")))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k (planned as TakeOrderedAndProject: each partition keeps
    k rows, the final merge sees k * partitions rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """T1 per key: ``row_number() <= k``; Spark inserts a WindowGroupLimit on
    both sides of the exchange, so a hot key ships only k rows per partition."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("long")))
