"""Error grouping.

Occurrences are reduced by partial aggregates (count, min_by / max_by on the
arrival sequence), so a hot signature is combined map-side.  Running counts
and "previous status" use the time-bucketed helpers of ``windows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.errors import ingest_signature
from vantage.operators.windows import prev_in_group, rank_in_group

OPEN, RESOLVED, ACKNOWLEDGED = "open", "resolved", "acknowledged"


def error_events(events: DataFrame) -> DataFrame:
    """Error rows of the event stream as ingested: C16b signature, type from
    category, message = traceback or category (2000 chars), NULL for empty
    module / model, user ids > 0 only."""
    tb = F.coalesce(F.col("traceback"), F.lit("")) if "traceback" in events.columns else F.lit("")
    msg = F.when(tb != "", tb).otherwise(F.col("category"))
    return (events.filter(F.col("is_error"))
            .select("env_id", "seq", "ts",
                    ingest_signature("category", "module", "model", "method").alias("signature"),
                    F.when(F.coalesce(F.col("category"), F.lit("")) != "", F.col("category"))
                    .otherwise(F.lit("Error")).alias("error_type"),
                    F.substring(msg, 1, 2000).alias("message"),
                    F.when(F.col("module") != "", F.col("module")).alias("module"),
                    F.when(F.col("model") != "", F.col("model")).alias("model"),
                    F.when(F.col("user_id") > 0, F.col("user_id")).alias("user_id")))


def group_errors(err: DataFrame) -> DataFrame:
    """A21 + A22: one row per (env, signature): occurrence_count, first_seen =
    ts of the first arrival, last_seen / message = last arrival, type / module /
    model from the first arrival, affected_users sorted distinct."""
    order = F.struct("seq")
    return (err.groupBy("env_id", "signature")
            .agg(F.count(F.lit(1)).alias("occurrence_count"),
                 F.min_by("ts", order).alias("first_seen"),
                 F.max_by("ts", order).alias("last_seen"),
                 F.max_by("message", order).alias("message"),
                 F.min_by("error_type", order).alias("error_type"),
                 F.min_by("module", order).alias("module"),
                 F.min_by("model", order).alias("model"),
                 F.array_sort(F.collect_set("user_id")).alias("affected_users")))


def merge_groups(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Fold a new batch of groups into the stored groups (full outer on
    the key): counts add, first_seen / type / module / model kept from the
    state, last_seen / message from the batch, user arrays unioned."""
    s = state.alias("s")
    d = delta.alias("d")
    on = (F.col("s.env_id") == F.col("d.env_id")) & (F.col("s.signature") == F.col("d.signature"))
    j = s.join(d, on, "full_outer")

    def pick(c, new_first):
        return (F.coalesce(F.col(f"d.{c}"), F.col(f"s.{c}")) if new_first
                else F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}")))

    return j.select(
        pick("env_id", False).alias("env_id"), pick("signature", False).alias("signature"),
        (F.coalesce(F.col("s.occurrence_count"), F.lit(0)) + F.coalesce(F.col("d.occurrence_count"), F.lit(0)))
        .alias("occurrence_count"),
        pick("first_seen", False).alias("first_seen"), pick("last_seen", True).alias("last_seen"),
        pick("message", True).alias("message"), pick("error_type", False).alias("error_type"),
        pick("module", False).alias("module"), pick("model", False).alias("model"),
        F.array_sort(F.array_union(F.coalesce(F.col("s.affected_users"), F.array().cast("array<int>")),
                                   F.coalesce(F.col("d.affected_users"), F.array().cast("array<int>"))))
        .alias("affected_users"))


def spike_alerts(err: DataFrame, threshold: int, base: DataFrame | None = None,
                 bucket: str = "1 hour") -> DataFrame:
    """One warning per (env, signature) at the occurrence where the running
    count reaches ``threshold`` exactly (``base`` holds stored counts);
    threshold <= 0 disables."""
    r = rank_in_group(err, ["env_id", "signature"], ["ts", "seq"], bucket=bucket, out_col="_rank")
    if base is not None:
        r = (r.join(base.select("env_id", "signature", F.col("occurrence_count").alias("_base")),
                    ["env_id", "signature"], "left")
             .withColumn("_rank", F.col("_rank") + F.coalesce(F.col("_base"), F.lit(0))).drop("_base"))
    hit = r.filter((F.col("_rank") == threshold) & F.lit(threshold > 0))
    return hit.select(
        "env_id", "signature", "seq", "ts", F.col("_rank").alias("occurrence_count"),
        F.lit("error_spike").alias("type"), F.lit("warning").alias("severity"),
        F.format_string("%s: %d occurrences of %s", F.col("error_type"), F.col("_rank"),
                        F.substring("signature", 1, 8)).alias("message"))


def reopen_alerts(err: DataFrame, changes: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """An occurrence right after a resolve / acknowledge (no occurrence in
    between) flips the group to open and fires a critical alert.

    ``changes``: (env_id, signature, ts, seq, status).  Occurrences and changes
    are merged in (ts, kind, seq) order; the alert fires where the previous
    row of the key is a closing change.  The running count at that point comes
    from ``rank_in_group`` over occurrences only.
    """
    occ = rank_in_group(err, ["env_id", "signature"], ["ts", "seq"], bucket=bucket, out_col="occurrence_count")
    o = occ.select("env_id", "signature", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("status"),
                   "occurrence_count")
    c = changes.select("env_id", "signature", "ts", "seq", F.lit(0).alias("kind"), "status",
                       F.lit(None).cast("long").alias("occurrence_count"))
    u = o.unionByName(c)
    p = prev_in_group(u, ["env_id", "signature"], ["ts", "kind", "seq"], ["kind", "status"], bucket=bucket)
    hit = p.filter((F.col("kind") == 1) & (F.col("prev_kind") == 0)
                   & F.col("prev_status").isin(RESOLVED, ACKNOWLEDGED))
    return hit.select(
        "env_id", "signature", "seq", "ts", "occurrence_count",
        F.lit("error_reopen").alias("type"), F.lit("critical").alias("severity"),
        F.format_string("Resolved error re-fired: %s (%d total occurrences)",
                        F.substring("signature", 1, 40), F.col("occurrence_count")).alias("message"))


def search_groups(groups: DataFrame, term: str) -> DataFrame:
    """case-insensitive substring on message, module or model; '%' and
    '_' inside the term act as wildcards; NULL columns never match."""
    pat = "%" + term + "%"
    m = (F.coalesce(F.col("message").ilike(pat), F.lit(False))
         | F.coalesce(F.col("module").ilike(pat), F.lit(False))
         | F.coalesce(F.col("model").ilike(pat), F.lit(False)))
    return groups.filter(m)
