"""N+1 (repeated-query) reports over window statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scoring import impact_score, n1_suggestion, ratio_hundredths, severity
from vantage.functions.sqltext import normalize_sql


def _detections(stats: DataFrame, since=None) -> DataFrame:
    d = stats.filter(F.col("n1_detected"))
    if since is not None:
        d = d.filter(F.col("period") >= F.lit(since).cast("timestamp"))
    return d


def n1_pattern_summary(stats: DataFrame, since=None) -> DataFrame:
    """A1: per (env, model, method) over windows with a detection: occurrences,
    total / peak calls, total / peak ms, avg calls per window, first / last
    window, sample SQL of the window with most calls (latest on ties)."""
    d = _detections(stats, since)
    return (d.groupBy("env_id", "model", "method")
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.sum("call_count").alias("total_calls"),
                 F.max("call_count").alias("peak_calls"),
                 F.sum("total_ms").alias("total_duration_ms"),
                 F.max("total_ms").alias("peak_ms"),
                 F.min("period").alias("first_seen"),
                 F.max("period").alias("last_seen"),
                 F.max_by("sample_sql", F.struct("call_count", "period")).alias("sample_sql"))
            .withColumn("avg_calls_per_window",
                        ratio_hundredths("total_calls", F.greatest(F.col("occurrences"), F.lit(1)))))


def score_patterns(patterns: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """C2-C4 + J8: impact score, severity, suggestion, signature.

    ``enrichment`` (env_id, model, method, sample_sql, signature) from recordings is
    left-joined: it fills an empty sample SQL and supplies the signature; else
    the signature is the normalised sample SQL.
    """
    p = patterns
    if enrichment is not None:
        e = enrichment.select("env_id", "model", "method", F.col("sample_sql").alias("_e_sql"),
                              F.col("signature").alias("_e_sig"), F.lit(True).alias("_e_hit"))
        p = (p.join(e, ["env_id", "model", "method"], "left")
             .withColumn("sample_sql", F.when(F.col("_e_hit") & (F.coalesce(F.col("sample_sql"), F.lit("")) == ""), F.col("_e_sql"))
                         .otherwise(F.col("sample_sql")))
             .withColumn("signature", F.when(F.col("_e_hit"), F.col("_e_sig"))
                         .when(F.coalesce(F.col("sample_sql"), F.lit("")) != "", normalize_sql(F.col("sample_sql")))
                         .otherwise(F.lit("")))
             .drop("_e_sql", "_e_sig", "_e_hit"))
    else:
        p = p.withColumn("signature", F.when(F.coalesce(F.col("sample_sql"), F.lit("")) != "",
                                             normalize_sql(F.col("sample_sql"))).otherwise(F.lit("")))
    return (p.withColumn("impact_score", impact_score("total_duration_ms", "occurrences", "peak_calls"))
            .withColumn("severity", severity("impact_score"))
            .withColumn("suggestion", n1_suggestion("model", "method", "peak_calls")))


def rank_patterns(scored: DataFrame, limit: int = 50) -> DataFrame:
    """A1 ordering: top ``limit`` per env by total ms (model, method break ties)."""
    w = Window.partitionBy("env_id").orderBy(F.col("total_duration_ms").desc(), "model", "method")
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .withColumn("rank", F.col("rank").cast("long")))


def n1_windows(stats: DataFrame, since=None) -> DataFrame:
    """A2: distinct windows with at least one detection, per env."""
    d = _detections(stats, since)
    # distinct (env, period) first: a two-stage plan instead of a distinct aggregate
    return (d.select("env_id", "period").distinct()
            .groupBy("env_id").agg(F.count(F.lit(1)).alias("n1_windows")))


def n1_timeline(stats: DataFrame, since=None, limit: int = 100) -> DataFrame:
    """A3: per (env, period) detections, newest ``limit`` periods per env."""
    d = _detections(stats, since)
    per = (d.groupBy("env_id", "period")
           .agg(F.count(F.lit(1)).alias("pattern_count"),
                F.sum("call_count").alias("total_calls"),
                F.sum("total_ms").alias("total_ms")))
    w = Window.partitionBy("env_id").orderBy(F.col("period").desc())
    return per.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def n1_summary(scored: DataFrame) -> DataFrame:
    """Per env over all patterns: count, wasted ms, critical / high
    counts, top (model, method) = first pattern in list order with the highest
    score (a zero best score leaves it empty)."""
    first = F.struct((-F.col("impact_score")).alias("s"), (-F.col("total_duration_ms")).alias("t"), "model", "method")
    return (scored.groupBy("env_id")
            .agg(F.count(F.lit(1)).alias("total_patterns"),
                 F.sum("total_duration_ms").alias("total_wasted_ms"),
                 F.count_if(F.col("severity") == "critical").alias("critical_count"),
                 F.count_if(F.col("severity") == "high").alias("high_count"),
                 F.max("impact_score").alias("_top_score"),
                 F.min(first).alias("_top"))
            .withColumn("top_model", F.when(F.col("_top_score") > 0, F.col("_top.model")).otherwise(F.lit("")))
            .withColumn("top_method", F.when(F.col("_top_score") > 0, F.col("_top.method")).otherwise(F.lit("")))
            .drop("_top", "_top_score"))
