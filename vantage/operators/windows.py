"""Window / analytic operators.

Hot keys: an environment or SQL signature may carry a third of all rows, so no
operator here partitions a window by a bare business key when the frame is
bounded in time.  W1 partitions by (key, slice of the window): a signed running
sum over the rows that enter and leave gives the exact count, and no partition
holds more than two slices of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.sqltext import normalize_sql


SLICES = 20  # slices of a counting window; divides every whole number of milliseconds


def _cols(xs: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in xs]


def interval_us(spec: str) -> int:
    """'2 seconds' / '6 hours' / '1 day' / '500 ms' -> microseconds."""
    n, unit = spec.strip().split(None, 1)
    unit = unit.lower().rstrip("s") if unit.lower() not in ("ms",) else "ms"
    mult = {"ms": 1_000, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
            "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}[unit]
    return int(float(n) * mult)


def window_count(df: DataFrame, keys: Sequence[str], window: str, ts_col: str = "ts",
                 seq_col: str = "seq", out_col: str = "n_in_window", closed_left: bool = True) -> DataFrame:
    """Rows with the same ``keys`` in ``[ts - window, ts]`` (or ``(ts - window,
    ts]`` when ``closed_left`` is false), counting the row itself and only
    earlier arrivals (order ``ts, seq``).  A row without a time counts 0.

    The window is cut into ``k`` slices (at most ``SLICES``), and a partition holds
    one slice of one key, so that a key with all rows is spread over many tasks even
    within one window.  The count is a running sum over three kinds of rows in a slice:

    - once a slice, the rows of the ``k`` slices before it (``+``), from counts;
    - the slice's own rows, +1 each;
    - the rows of the slice ``k`` before it, -1 at the time they leave the window.

    The counts of a slice see at most ``2 k`` other counts, in spans of one window.
    """
    w_us = interval_us(window)
    k = next(d for d in range(SLICES, 0, -1) if w_us % d == 0)
    keys = list(keys)
    base = (df.withColumn("_at", F.unix_micros(F.col(ts_col)))
            .withColumn("_b", F.floor(F.col("_at") / F.lit(w_us // k)).cast("long")))
    timed = base.select(*keys, "_at", "_b").filter(F.col("_at").isNotNull())

    counts = (timed.groupBy(*_cols(keys), F.col("_b")).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_span", F.floor(F.col("_b") / F.lit(k)).cast("long")).withColumn("_own", F.lit(True)))
    later = counts.withColumn("_span", F.col("_span") + 1).withColumn("_own", F.lit(False))
    before = Window.partitionBy(*_cols(keys), F.col("_span")).orderBy("_b").rangeBetween(-k, -1)
    prior = (counts.unionByName(later).withColumn("_w", F.sum("_c").over(before))
             .filter(F.col("_own") & F.col("_w").isNotNull())
             .select(*keys, "_b", "_w", F.lit(-2).alias("_kind")))

    # one scan gives the rows that enter and those that leave; what leaves carries keys only
    enters = F.struct(F.col("_at"), F.col("_b"), F.lit(1).cast("long").alias("_w"), F.lit(0).alias("_kind"))
    leaves = F.struct((F.col("_at") + w_us).alias("_at"), (F.col("_b") + k).alias("_b"), F.lit(-1).cast("long").alias("_w"),
                      F.lit(1 if closed_left else -1).alias("_kind"))
    both = base.withColumn("_move", F.explode(F.array(enters, leaves))).filter("_move._kind = 0 or _at is not null")
    payload = [c for c in df.columns if c not in keys]
    moves = both.select(*keys, *[F.when(F.col("_move._kind") == 0, F.col(c)).alias(c) for c in payload], "_move.*")
    rows = moves.unionByName(prior, allowMissingColumns=True)
    running = (Window.partitionBy(*_cols(keys), F.col("_b"))
               .orderBy(F.col("_at").asc_nulls_first(), F.col("_kind"), F.col(seq_col))
               .rowsBetween(Window.unboundedPreceding, 0))
    n = F.when(F.col("_at").isNull(), 0).otherwise(F.sum("_w").over(running))
    return (rows.withColumn(out_col, n.cast("long")).filter(F.col("_kind") == 0)
            .drop("_at", "_b", "_w", "_kind"))


def flag_repeats(df: DataFrame, keys: Sequence[str], window: str, threshold: int,
                 ts_col: str = "ts", seq_col: str = "seq", out_col: str = "is_n1",
                 valid: Column | None = None) -> DataFrame:
    """Flag a row when >= ``threshold`` rows with the same ``keys`` fall in
    ``[ts - window, ts]``, counting itself and only earlier arrivals
    (order ``ts, seq``).  Rows where ``valid`` is false never flag."""
    c = window_count(df, keys, window, ts_col, seq_col, "_n")
    flag = F.col("_n") >= F.lit(threshold)
    if valid is not None:
        flag = flag & F.coalesce(valid, F.lit(False))
    return c.withColumn(out_col, flag).drop("_n")


def flag_n1(events: DataFrame, window: str = "2 seconds", threshold: int = 10) -> DataFrame:
    """W1 + C1 on the event stream: signature = normalised SQL per environment;
    empty SQL never flags."""
    ev = events.withColumn("signature", normalize_sql(F.col("sql")))
    return flag_repeats(ev, ["env_id", "signature"], window, threshold,
                        valid=F.coalesce(F.col("signature"), F.lit("")) != "")


def counter_deltas(snap: DataFrame, keys: Sequence[str], poll_col: str = "poll_seq",
                   calls_col: str = "calls", total_col: str = "total_ms",
                   max_col: str = "max_ms") -> DataFrame:
    """Cumulative-counter delta against the previous poll.

    First sight and polls that skip a snapshot emit nothing; delta_calls <= 0
    (no change or counter reset) emits nothing; avg = delta_ms / delta_calls
    truncated, 0 -> int(max_ms).
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(F.col(poll_col))
    prev_poll = F.lag(poll_col).over(w)
    prev_calls = F.lag(calls_col).over(w)
    prev_total = F.lag(total_col).over(w)
    d = (snap.withColumn("_pp", prev_poll).withColumn("_pc", prev_calls).withColumn("_pt", prev_total)
         .filter(F.col("_pp").isNotNull() & (F.col(poll_col) - F.col("_pp") == 1))
         .withColumn("delta_calls", (F.col(calls_col) - F.col("_pc")).cast("long"))
         .filter(F.col("delta_calls") > 0)
         .withColumn("delta_ms", F.col(total_col) - F.col("_pt")))
    avg = (F.col("delta_ms") / F.col("delta_calls")).cast("int")  # towards zero
    return (d.withColumn("avg_ms", avg)
            .withColumn("duration_ms", F.when(F.col("avg_ms") == 0, F.col(max_col).cast("int"))
                        .otherwise(F.col("avg_ms")))
            .drop("_pp", "_pc", "_pt"))


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank_col: str | None = None) -> DataFrame:
    """The ``n`` newest rows per key (``order`` newest first,
    ending in a unique column for a total order).  ``row_number() <= n`` with
    small ``n`` is planned with a per-partition WindowGroupLimit before the
    shuffle, so a hot key ships at most n rows per input partition."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumn(rank_col, F.col("_rn").cast("long")).drop("_rn") if rank_col else out.drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest row per key, as a partial aggregate (max_by of the whole row),
    so a hot key is reduced map-side instead of sorted in one task."""
    other = [c for c in df.columns if c not in keys]
    order_struct = F.struct(*order)
    return (df.groupBy(*_cols(keys))
            .agg(F.max_by(F.struct(*_cols(other)), order_struct).alias("_r"))
            .select(*_cols(keys), "_r.*"))


def running_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    dur_col: str = "duration_ms", out_col: str = "start_ms") -> DataFrame:
    """start = sum of earlier durations in the group (0 for the first)."""
    w = (Window.partitionBy(*_cols(keys)).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out_col, F.coalesce(F.sum(dur_col).over(w), F.lit(0)).cast("long"))


def offsets_from_first(df: DataFrame, keys: Sequence[str], ts_col: str = "ts",
                       out_col: str = "start_ms") -> DataFrame:
    """Whole milliseconds since the group's first timestamp."""
    w = Window.partitionBy(*_cols(keys))
    first_us = F.min(F.unix_micros(F.col(ts_col))).over(w)
    return df.withColumn(out_col, F.floor((F.unix_micros(F.col(ts_col)) - first_us) / 1000).cast("long"))


def ordinal_ids(df: DataFrame, keys: Sequence[str], order: Sequence[Column], prefix: str,
                out_col: str = "id") -> DataFrame:
    """``prefix-i`` ordinal ids (0-based) within each group."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(out_col, F.concat(F.lit(prefix + "-"), (F.row_number().over(w) - 1).cast("string")))


def last_n_oldest_first(df: DataFrame, keys: Sequence[str], seq_col: str, n: int) -> DataFrame:
    """Last ``n`` rows in arrival order per key (n clamped to 1..1000),
    returned with a 0-based position oldest first."""
    n = max(1, min(int(n), 1000))
    w = Window.partitionBy(*_cols(keys)).orderBy(F.col(seq_col).desc())
    kept = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    w2 = Window.partitionBy(*_cols(keys)).orderBy(F.col(seq_col))
    return kept.withColumn("pos", (F.row_number().over(w2) - 1).cast("int")).drop("_rn")


# ---------------------------------------------------------------- hot-key-safe
# Exact "rank within key" and "previous row within key" without putting a whole
# key into one window partition: rows are bucketed by time; per-bucket counts
# (or last rows) are tiny partial aggregates whose own window runs over one row
# per (key, bucket); the big side is windowed per (key, bucket) only.

def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def _bucketed(df: DataFrame, ts_col: str, bucket) -> DataFrame:
    """Bucket by time (``bucket`` like '1 hour' on a timestamp column) or by
    position (``bucket`` an int width on an integer column such as a line
    number)."""
    if isinstance(bucket, int):
        return df.withColumn("_b", F.floor(F.col(ts_col) / F.lit(bucket)).cast("long"))
    return df.withColumn("_b", F.floor(F.unix_micros(F.col(ts_col)) / F.lit(interval_us(bucket))).cast("long"))


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts_col: str = "ts",
                  bucket: str = "1 hour", out_col: str = "rank") -> DataFrame:
    """1-based ``row_number()`` within ``keys`` ordered by ``order`` (which must
    start with ``ts_col``), computed as per-bucket offset + rank in bucket."""
    keys = list(keys)
    d = _bucketed(df, ts_col, bucket)
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*_cols(keys)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    offs = offs.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_b").alias("_k_b"), "_off")
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col("_k_" + k))
        cond = e if cond is None else cond & e
    cond = cond & (F.col("_b") == F.col("_k_b"))
    j = d.join(offs, cond, "inner").drop(*["_k_" + k for k in keys], "_k_b")
    wr = Window.partitionBy(*_cols(keys), F.col("_b")).orderBy(*_cols(order))
    return j.withColumn(out_col, (F.col("_off") + F.row_number().over(wr)).cast("long")).drop("_b", "_off")


def prev_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  ts_col: str = "ts", bucket: str = "1 hour", prefix: str = "prev_") -> DataFrame:
    """``lag(v)`` for each of ``values`` within ``keys`` ordered by ``order``
    (starting with ``ts_col``); NULL for a key's first row."""
    keys, values = list(keys), list(values)
    d = _bucketed(df, ts_col, bucket)
    last = (d.groupBy(*keys, "_b")
            .agg(F.max_by(F.struct(*_cols(values)), F.struct(*_cols(order))).alias("_last")))
    wl = Window.partitionBy(*_cols(keys)).orderBy("_b")
    pl = last.withColumn("_pl", F.lag("_last").over(wl)).drop("_last")
    pl = pl.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_b").alias("_k_b"), "_pl")
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col("_k_" + k))
        cond = e if cond is None else cond & e
    cond = cond & (F.col("_b") == F.col("_k_b"))
    j = d.join(pl, cond, "inner").drop(*["_k_" + k for k in keys], "_k_b")
    wr = Window.partitionBy(*_cols(keys), F.col("_b")).orderBy(*_cols(order))
    first = F.row_number().over(wr) == 1
    for v in values:
        j = j.withColumn(prefix + v, F.when(first, F.col("_pl")[v]).otherwise(F.lag(v).over(wr)))
    return j.drop("_b", "_pl")


def running_sum_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str,
                         ts_col: str = "ts", bucket: str = "1 hour", out_col: str = "running") -> DataFrame:
    """Running ``sum(value_col)`` within ``keys`` ordered by ``order`` (which
    starts with ``ts_col``), inclusive: per-bucket sums give the offset of
    earlier buckets, the big side is windowed per (key, bucket) only."""
    def joined(before: Column, here: Column) -> Column:
        return (F.coalesce(before, F.lit(0)) + here).cast("long")

    return _running(df, keys, order, value_col, F.sum, joined, ts_col, bucket, out_col)


def running_max_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str,
                         ts_col: str = "ts", bucket: str = "1 hour", out_col: str = "running") -> DataFrame:
    """Running ``max(value_col)`` in the same way; NULL values do not count, so that with
    values on one kind of rows only, it is an as-of lookup for the others."""
    return _running(df, keys, order, value_col, F.max, F.greatest, ts_col, bucket, out_col)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value_col: str, fold, joined,
             ts_col: str, bucket, out_col: str) -> DataFrame:
    keys = list(keys)
    d = _bucketed(df, ts_col, bucket)
    sums = d.groupBy(*keys, "_b").agg(fold(value_col).alias("_n"))
    w = Window.partitionBy(*_cols(keys)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.withColumn("_off", fold("_n").over(w)).drop("_n")
    offs = offs.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_b").alias("_k_b"), "_off")
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col("_k_" + k))
        cond = e if cond is None else cond & e
    cond = cond & (F.col("_b") == F.col("_k_b"))
    j = d.join(offs, cond, "inner").drop(*["_k_" + k for k in keys], "_k_b")
    wr = (Window.partitionBy(*_cols(keys), F.col("_b")).orderBy(*_cols(order))
          .rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn(out_col, joined(F.col("_off"), fold(value_col).over(wr))).drop("_b", "_off")
