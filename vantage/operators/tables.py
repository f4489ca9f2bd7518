"""Table maintenance and listing operators.

All are single-pass DataFrame plans.  ``now`` is always a parameter so runs
are repeatable.  Small catalogs (policies, presets, channels per tenant) are
joined normally unless their size is bounded by configuration.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.windows import latest_per_key

# Retention defaults (days, or count for schema snapshots).
RETENTION_DEFAULTS = {
    "error_traces_days": 7,
    "profiler_recordings_days": 7,
    "budget_samples_days": 30,
    "schema_snapshots_keep": 10,
    "raw_logs_days": 3,
    "audit_log_days": 90,
}
PER_PAGE_DEFAULT, PER_PAGE_MAX = 25, 100


def _cols(xs: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in xs]


# ------------------------------------------------------------------ paging

def page_params(page: int | None, per_page: int | None) -> tuple[int, int]:
    """Page >= 1; per_page default 25, at most 100."""
    p = page if page and page >= 1 else 1
    pp = per_page if per_page and per_page >= 1 else PER_PAGE_DEFAULT
    return p, min(pp, PER_PAGE_MAX)


def clamp_limit(limit: int | None, default: int, lo: int = 1, hi: int | None = None) -> int:
    """Out-of-range limits fall back to the default."""
    if limit is None or limit < lo or (hi is not None and limit > hi):
        return default
    return limit


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], page_no: int | None,
         per_page: int | None) -> DataFrame:
    """One page per key (``order`` must end in a unique column) with
    total, total_pages, has_next, has_prev.  ``row_number() <= offset + n``
    lets Spark cut each partition to the page end before the shuffle."""
    p, pp = page_params(page_no, per_page)
    lo, hi = (p - 1) * pp, p * pp
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    totals = df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("total"))
    rows = df.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") > lo) & (F.col("_rn") <= hi))
    tp = F.ceil(F.col("total") / F.lit(pp)).cast("long")
    return (rows.join(totals, list(keys))
            .withColumn("total_pages", tp)
            .withColumn("page", F.lit(p)).withColumn("per_page", F.lit(pp))
            .withColumn("has_next", F.lit(p) < tp).withColumn("has_prev", F.lit(p > 1))
            .withColumn("row_in_page", (F.col("_rn") - lo - 1).cast("long")).drop("_rn"))


def page_global(df: DataFrame, order: Sequence[Column], page_no: int | None, per_page: int | None) -> DataFrame:
    """T2 without keys: ``offset().limit()`` over a total order."""
    p, pp = page_params(page_no, per_page)
    return df.orderBy(*order).offset((p - 1) * pp).limit(pp)


# ------------------------------------------------------------- retention

POLICY_SCHEMA = T.StructType([T.StructField(k, T.IntegerType()) for k in RETENTION_DEFAULTS])


def parse_policy(json_col: Column) -> Column:
    """Retention JSON -> struct; zero / missing / bad JSON -> defaults;
    negative values are kept (they disable that retention)."""
    s = F.from_json(json_col, POLICY_SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(F.when(s[k] != 0, s[k]), F.lit(v)).alias(k)
                      for k, v in RETENTION_DEFAULTS.items()])


def retain_by_age(rows: DataFrame, policies: DataFrame, tenant_col: str, ts_col: str, days_col: str,
                  now) -> DataFrame:
    """U4: survivors = rows newer than ``now - days`` of their tenant's policy;
    a policy <= 0 disables deletion.  ``policies`` (tenant, days) is one row
    per tenant and joined on the tenant key."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.col(days_col))
    j = rows.join(policies.select(tenant_col, days_col), tenant_col, "left")
    keep = (F.col(days_col).isNull() | (F.col(days_col) <= 0)
            | (F.col(ts_col).cast("timestamp") >= cutoff))
    return j.filter(keep)


def orphan_refs(expired: DataFrame, ref_col: str) -> DataFrame:
    """Object references of rows about to be deleted (non-NULL only)."""
    return expired.filter(F.col(ref_col).isNotNull()).select(ref_col).distinct()


# --------------------------------------------------------- status / patch

def fold_status(changes: DataFrame, keys: Sequence[str], status_col: str, order: Sequence[str]) -> DataFrame:
    """Current status per key = status of the last change (partial
    aggregate, so a hot key is reduced map-side)."""
    o = F.struct(*_cols(order))
    return (changes.groupBy(*_cols(keys))
            .agg(F.max_by(F.col(status_col), o).alias(status_col),
                 F.max(o).alias("_o"), F.count(F.lit(1)).alias("changes"))
            .select(*keys, status_col, "changes", *[F.col("_o." + c).alias("last_" + c) for c in order]))


def patch_coalesce(base: DataFrame, patch: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``coalesce(new, old)`` per column from a patch table."""
    p = patch.select(key, *[F.col(c).alias("_new_" + c) for c in cols])
    j = base.join(p, key, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col("_new_" + c), F.col(c))).drop("_new_" + c)
    return j


def retry_reset(outbox: DataFrame, now, max_attempts: int = 3, within_hours: int = 24) -> DataFrame:
    """Failed deliveries with attempt < max younger than ``within_hours``
    go back to pending."""
    young = F.col("created_at") > F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(within_hours))
    reset = (F.col("status") == "failed") & (F.col("attempt") < max_attempts) & young
    return (outbox.withColumn("was_reset", reset)
            .withColumn("status", F.when(F.col("was_reset"), F.lit("pending")).otherwise(F.col("status"))))


# ----------------------------------------------------------- joins / lists

def stale_agents(agents: DataFrame, heartbeats: DataFrame, key: str, ts_col: str, now, interval_days: int) -> DataFrame:
    """Latest heartbeat per agent (partial max), left-joined; stale when
    none or older than ``now - interval``; no heartbeat reads as the epoch."""
    last = heartbeats.groupBy(key).agg(F.max(F.col(ts_col).cast("timestamp")).alias("last_seen"))
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(interval_days))
    j = agents.join(last, key, "left")
    return (j.withColumn("is_stale", F.col("last_seen").isNull() | (F.col("last_seen") < cutoff))
            .withColumn("last_seen", F.coalesce(F.col("last_seen"), F.lit("1970-01-01 00:00:00").cast("timestamp"))))


def fan_out(alerts: DataFrame, channels: DataFrame, tenant_col: str) -> DataFrame:
    """One pending delivery per (alert, active channel of its tenant)."""
    ch = channels.filter(F.col("is_active")).select(tenant_col, "channel_id", "channel_type")
    return (alerts.join(ch, tenant_col)
            .withColumn("status", F.lit("pending")).withColumn("attempt", F.lit(0)))


def pending_deliveries(outbox: DataFrame, channels: DataFrame, alerts: DataFrame, alert_key: Sequence[str],
                       limit: int) -> DataFrame:
    """The oldest ``limit`` pending deliveries with their channel and alert, by an
    inner three-way join; deliveries whose channel or alert is gone are left out."""
    ch = channels.select("channel_id", "channel_type")
    return (outbox.filter(F.col("status") == "pending")
            .join(ch, "channel_id").join(alerts, list(alert_key))
            .orderBy("created_at", *alert_key, "channel_id").limit(limit))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """W4 alias (see ``windows.latest_per_key``)."""
    return latest_per_key(df, keys, order)


def counts(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Plain and filtered counts in one pass per key."""
    return df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("total"),
                                        *[F.count_if(c).alias(n) for n, c in flags.items()])


def total_pages(total: int, per_page: int) -> int:
    return max(1, math.ceil(total / per_page)) if per_page else 1


# ------------------------------------------------------ request limiting

def request_rate(requests: DataFrame, keys: Sequence[str], window: str, limit: int) -> DataFrame:
    """A request is allowed when fewer than ``limit`` earlier requests
    (rejected ones included) of its key fall in ``(ts - window, ts]``."""
    from vantage.operators.windows import window_count
    c = window_count(requests, keys, window, out_col="_n", closed_left=False)
    return (c.withColumn("prior_requests", F.col("_n") - 1)
            .withColumn("allowed", F.col("prior_requests") < limit).drop("_n"))


LOCK_SCHEMA = "identifier string, seq long, ts timestamp, success boolean, attempt long, locked boolean, locked_until timestamp"


def login_lockout(attempts: DataFrame, window: str = "15 minutes", max_attempts: int = 5,
                  lockout: str = "30 minutes") -> DataFrame:
    """Per identifier, failures count from the first failure of a window
    (the counter expires ``window`` after it); success clears the counter; a
    failure at count >= max locks until ts + lockout.  No identifier is
    gathered into one task; attempts without identifier are one of their own.

    1. segment = number of successes up to the attempt (bucketed running sum):
       a success resets the counter, so segments are independent.
    2. window starts within a segment form a greedy gap chain (the first
       failure, then the first failure at or after start + window, ...).
    3. a failure's window start lies within ``window`` before it: a window
       per (segment, time bucket) with the previous bucket's starts as context.
    4. attempt = rank of the failure within its window (bucketed rank)."""
    from vantage.operators.chains import greedy_chain
    from vantage.operators.windows import interval_us, rank_in_group, running_sum_in_group
    w_us, l_us = interval_us(window), interval_us(lockout)
    # a struct is equal to another with the same NULLs, so joins keep attempts without identifier
    a = attempts.select(F.struct("identifier").alias("identifier"), "seq", "ts", "success")
    seg = running_sum_in_group(a.withColumn("_succ", F.col("success").cast("long")), ["identifier"],
                               ["ts", "seq"], "_succ", out_col="_seg").drop("_succ")
    fails = seg.filter(~F.col("success"))
    starts = greedy_chain(fails, ["identifier", "_seg"], "ts", "seq", window, out_col="_start")
    s2 = (starts.withColumn("_t", F.unix_micros("ts"))
          .withColumn("_b", F.floor(F.col("_t") / F.lit(w_us)).cast("long")))
    marker = F.when(F.col("_start"), F.struct(F.col("_t").alias("t"), F.col("seq").alias("s")))
    own = s2.withColumn("_m", marker).withColumn("_own", F.lit(True))
    ctx = (s2.filter("_start").select("identifier", "_seg", "_t", "seq", (F.col("_b") + 1).alias("_b"))
           .withColumn("_m", F.struct(F.col("_t").alias("t"), F.col("seq").alias("s"))).withColumn("_own", F.lit(False)))
    u = own.unionByName(ctx, allowMissingColumns=True)
    wl = (Window.partitionBy("identifier", "_seg", "_b").orderBy("_t", "seq")
          .rowsBetween(Window.unboundedPreceding, 0))
    located = (u.withColumn("_win", F.last("_m", ignorenulls=True).over(wl)).filter("_own")
               .drop("_own", "_m", "_b", "_t"))
    ranked = rank_in_group(located, ["identifier", "_seg", "_win"], ["ts", "seq"], bucket="1 minute",
                           out_col="attempt")
    failed = ranked.select("identifier", "seq", "ts", "success", "attempt",
                           (F.col("attempt") >= max_attempts).alias("locked"))
    failed = failed.withColumn("locked_until", F.when(F.col("locked"), F.timestamp_micros(
        F.unix_micros("ts") + F.lit(l_us))))
    ok = seg.filter(F.col("success")).select("identifier", "seq", "ts", "success", F.lit(0).cast("long").alias("attempt"),
                                             F.lit(False).alias("locked"),
                                             F.lit(None).cast("timestamp").alias("locked_until"))
    return failed.unionByName(ok).withColumn("identifier", F.col("identifier.identifier"))


def login_lockout_local(attempts: DataFrame, window: str = "15 minutes", max_attempts: int = 5,
                        lockout: str = "30 minutes") -> DataFrame:
    """U10 as an ordered fold per identifier (``applyInPandas``)."""
    import pandas as pd

    from vantage.operators.windows import interval_us
    w_us, l_us = interval_us(window), interval_us(lockout)
    d = attempts.select("identifier", "seq", "ts", "success", F.unix_micros("ts").alias("_t"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "seq"], kind="mergesort")
        count, start = 0, None
        att, locked, until = [], [], []
        for t, ok in zip(pdf["_t"].to_numpy(), pdf["success"].to_numpy()):
            if ok:
                count, start = 0, None
                att.append(0)
                locked.append(False)
                until.append(None)
                continue
            if start is None or t >= start + w_us:
                count, start = 1, t
            else:
                count += 1
            att.append(count)
            hit = count >= max_attempts
            locked.append(hit)
            until.append(pd.Timestamp(int(t + l_us), unit="us", tz="UTC") if hit else None)
        out = pdf[["identifier", "seq", "ts", "success"]].copy()
        out["attempt"] = att
        out["locked"] = locked
        out["locked_until"] = pd.Series(until, index=out.index, dtype="datetime64[us, UTC]")
        return out

    return d.groupBy("identifier").applyInPandas(fold, schema=LOCK_SCHEMA)
