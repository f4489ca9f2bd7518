"""Performance budgets.

A *batch* is one (env, period) window of profiler / orm / sql events.  Module
statistics are one partial aggregate per (batch, module); budgets are a small
catalog joined on (env, module).  Alert cool-down (W9) is a greedy fold per
(env, module, budget) whose input is one breach per batch window, so its size
per key is bounded by the time span / window length, not by event volume.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scoring import pct_hundredths
from vantage.operators.windows import interval_us

PROFILE_CATEGORIES = ("profiler", "orm", "sql")


def batches(events: DataFrame, window: str) -> DataFrame:
    """F12 + batch key: profiler / orm / sql events with their window start."""
    return (events.filter(F.col("category").isin(*PROFILE_CATEGORIES))
            .withColumn("period", F.window("ts", window).start))


def module_stats(batch_events: DataFrame, keys: Sequence[str] = ("env_id", "period")) -> DataFrame:
    """Per (batch, module): total / sql / orm / python ms and counts, plus
    the batch total over *all* events (module-less ones included)."""
    keys = list(keys)
    totals = batch_events.groupBy(*keys).agg(F.sum(F.col("duration_ms").cast("long")).alias("total_ms"))
    d = F.col("duration_ms").cast("long")
    cat = F.col("category")
    mods = (batch_events.filter(F.coalesce(F.col("module"), F.lit("")) != "")
            .groupBy(*keys, "module")
            .agg(F.sum(d).alias("module_ms"),
                 F.sum(F.when(cat == "sql", d).otherwise(0)).alias("sql_ms"),
                 F.count_if(cat == "sql").alias("sql_count"),
                 F.sum(F.when(cat == "orm", d).otherwise(0)).alias("orm_ms"),
                 F.count_if(cat == "orm").alias("orm_count"),
                 F.sum(F.when(cat.isin("python", "profiler"), d).otherwise(0)).alias("python_ms")))
    # both sides are aggregated on a prefix of the same keys: the join reuses
    # the aggregation's partitioning on (keys)
    return mods.join(totals, keys)


def overhead_samples(mod_stats: DataFrame, budgets: DataFrame) -> DataFrame:
    """A13 + J7: one sample per (batch, active budget whose module has events);
    overhead = module_ms / total_ms * 100 (2 dp, exact hundredths); breach when
    the unrounded overhead exceeds the threshold; nothing when total is 0."""
    b = budgets.filter(F.col("is_active")).select("budget_id", "env_id", "module", "endpoint", "threshold_pct")
    s = mod_stats.filter(F.col("total_ms") > 0).join(b, ["env_id", "module"])
    return (s.withColumn("overhead_pct", pct_hundredths("module_ms", "total_ms"))
            .withColumn("breach", F.col("module_ms") * 100 > F.col("threshold_pct").cast("long") * F.col("total_ms")))


def function_breakdown(batch_events: DataFrame, keys: Sequence[str] = ("env_id", "period")) -> DataFrame:
    """Per (batch, module, model, method, category): ms, calls, pct of the
    module's ms, and position by ms desc (model, method, category break ties).
    Rows with neither model nor method are skipped."""
    keys = list(keys)
    ev = batch_events.filter(F.coalesce(F.col("module"), F.lit("")) != "")
    fk = keys + ["module", "model", "method", "category"]
    f = (ev.filter((F.coalesce(F.col("model"), F.lit("")) != "") | (F.coalesce(F.col("method"), F.lit("")) != ""))
         .groupBy(*fk).agg(F.sum(F.col("duration_ms").cast("long")).alias("duration_ms"),
                           F.count(F.lit(1)).alias("call_count")))
    mod_total = ev.groupBy(*keys, "module").agg(F.sum(F.col("duration_ms").cast("long")).alias("_mod_ms"))
    w = Window.partitionBy(*keys, "module").orderBy(F.col("duration_ms").desc(), "model", "method", "category")
    return (f.join(mod_total, keys + ["module"])
            .withColumn("pct", pct_hundredths("duration_ms", "_mod_ms"))
            .withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
            .drop("_mod_ms"))


def budget_trend(samples: DataFrame, budgets: DataFrame, now, days: int = 7) -> DataFrame:
    """A5: per budget over samples newer than ``now - days``: mean overhead
    (2 dp, half up), max, count; zeros when there are none."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    h = F.round(F.col("overhead_pct") * 100).cast("long")
    agg = (samples.filter(F.col("period") > since)
           .groupBy("budget_id")
           .agg(F.sum(h).alias("_sum_h"), F.count(F.lit(1)).alias("sample_count"),
                F.max("overhead_pct").alias("max_overhead")))
    avg_h = F.floor((F.col("_sum_h") * 2 + F.col("sample_count")) / (F.col("sample_count") * 2))
    return (budgets.select("budget_id").join(agg, "budget_id", "left")
            .select("budget_id",
                    F.coalesce(avg_h.cast("double") / 100.0, F.lit(0.0)).alias("avg_overhead"),
                    F.coalesce(F.col("max_overhead"), F.lit(0.0)).alias("max_overhead"),
                    F.coalesce(F.col("sample_count"), F.lit(0)).alias("sample_count")))


def tenths_text(part, total):
    """'%.1f' of part / total * 100 from integers, ties to even (as the
    reference's formatter does on exact binary ties)."""
    num = part.cast("long") * 1000
    q = F.floor(num / total).cast("long")
    r = num - q * total
    q2 = (F.when(r * 2 > total, q + 1)
          .when((r * 2 == total) & (q % 2 == 1), q + 1).otherwise(q))
    return F.concat((F.floor(q2 / 10)).cast("long").cast("string"), F.lit("."), (q2 % 10).cast("string"))


def cooldown_fold(breaches: DataFrame, keys: Sequence[str], ts_col: str, cooldown: str) -> DataFrame:
    """Keep a breach unless one was kept for the same key less than
    ``cooldown`` earlier; suppressed breaches do not extend the gap.

    Greedy and order-dependent; every key runs the pointer-doubling chain of
    ``operators.chains``, which never gathers a key into one task.  Of breaches
    at one time only the first, by its other columns, can be kept; rows with
    NULL keys are a key of their own."""
    from vantage.operators.chains import greedy_chain
    keys = list(keys)
    rest = [c for c in breaches.columns if c not in (*keys, ts_col)]
    one = (breaches.groupBy(F.struct(*keys).alias("_k"), F.col(ts_col))
           .agg(F.min(F.struct(*rest) if rest else F.struct(F.lit(0))).alias("_row")))
    kept = greedy_chain(one, ["_k"], ts_col, None, cooldown, out_col="_kept").filter("_kept")
    place = {k: f"_k.{k}" for k in keys} | {c: f"_row.{c}" for c in rest} | {ts_col: ts_col}
    return kept.select(*[F.col(place[c]).alias(c) for c in breaches.columns])


def cooldown_fold_local(breaches: DataFrame, keys: Sequence[str], ts_col: str, cooldown: str) -> DataFrame:
    """W9 as a sorted fold per key (``applyInPandas``): the reference
    implementation used by tests to cross-check ``cooldown_fold``."""
    keys = list(keys)
    c_us = interval_us(cooldown)
    schema = breaches.schema
    d = breaches.withColumn("_t", F.unix_micros(F.col(ts_col)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t"], kind="mergesort")
        t = pdf["_t"].to_numpy()
        keep = [False] * len(t)
        last = None
        for i, x in enumerate(t):
            if last is None or x - last >= c_us:
                keep[i] = True
                last = x
        return pdf.loc[keep].drop(columns=["_t"])

    return d.groupBy(*keys).applyInPandas(fold, schema=schema)


def alert_rows(kept: DataFrame) -> DataFrame:
    """The alert of each breach, with C5 severity, message text and metadata (JSON)."""
    thr = F.col("threshold_pct")
    sev = F.when((thr > 0) & (F.col("module_ms") * 200 >= thr.cast("long") * 3 * F.col("total_ms")),
                 "critical").otherwise("warning")
    return kept.select(
        "env_id", "budget_id", "module", F.col("period").alias("created_at"),
        F.lit("budget_exceeded").alias("type"), sev.alias("severity"),
        F.format_string("Module '%s' exceeded performance budget: %s%% overhead (threshold: %d%%)",
                        F.col("module"), tenths_text(F.col("module_ms"), F.col("total_ms")), thr).alias("message"),
        (F.col("overhead_pct") - thr).alias("exceeded_by"),
        F.to_json(F.struct("module", "endpoint", "budget_id", "overhead_pct", "threshold_pct", (F.col("overhead_pct") - thr).alias("exceeded_by"),
                           "total_ms", "module_ms")).alias("metadata"))


def budget_alerts(samples: DataFrame, cooldown: str = "10 minutes") -> DataFrame:
    """R19 (alert part): breaches -> cool-down (W9) -> alert rows with C5
    severity and message text."""
    br = samples.filter(F.col("breach")).select(
        "env_id", "budget_id", "module", "endpoint", "period", "threshold_pct", "total_ms", "module_ms",
        "overhead_pct")
    kept = cooldown_fold(br, ["env_id", "module", "budget_id"], "period", cooldown)
    return alert_rows(kept).drop("metadata")
