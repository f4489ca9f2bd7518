"""Raw-event sampling.

The random draw of the reference is replaced by a repeatable arithmetic hash
of the event id, so reruns (and a lost executor's retry) keep the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators.windows import rank_in_group

# Fixed presets: (env_type, mode, sample_rate, slow_threshold_ms, always-capture categories).
PRESETS = [
    ("development", "full", 1.0, 50, ""),
    ("staging", "sampled", 0.25, 100, "error,slow_query,n1"),
    ("production", "aggregated_only", 0.05, 200, "error,slow_query,n1"),
]
DRAW_MULT = 2654435761
DRAW_MOD = 1_000_000


def presets(spark: SparkSession) -> DataFrame:
    """the three presets as a (fixed, 3-row) dimension."""
    return spark.createDataFrame(PRESETS, "env_type string, mode string, sample_rate double, "
                                          "slow_threshold_ms int, always_capture string")


def draw(seq) -> F.Column:
    """Repeatable uniform draw in [0, 1e6) from an event id."""
    return F.pmod(F.pmod(F.col(seq).cast("long"), F.lit(DRAW_MOD)) * DRAW_MULT, F.lit(DRAW_MOD))  # no overflow for any id


def allow(events: DataFrame, config: DataFrame) -> DataFrame:
    """keep flag per event: critical (error, N+1, slow, listed category)
    always; else by mode: full keeps, sampled keeps draw < rate, aggregated
    drops, unknown mode keeps.  ``config`` has one row per env_type and is
    broadcast (its size is the number of presets)."""
    e = events.join(F.broadcast(config), "env_type", "left")
    cats = F.split(F.lower(F.coalesce(F.col("always_capture"), F.lit(""))), ",")
    slow = (F.col("slow_threshold_ms") > 0) & (F.col("duration_ms") > F.col("slow_threshold_ms"))
    critical = (F.col("is_error") | F.col("is_n1") | F.coalesce(slow, F.lit(False))
                | F.array_contains(cats, F.lower(F.col("category"))))
    by_mode = (F.when(F.col("mode") == "full", F.lit(True))
               .when(F.col("mode") == "sampled", draw("seq") < F.col("sample_rate") * DRAW_MOD)
               .when(F.col("mode") == "aggregated_only", F.lit(False))
               .otherwise(F.lit(True)))
    return e.withColumn("allowed", critical | by_mode)


def cap_raw(events: DataFrame, window: str, cap: int, keys=("env_id",)) -> DataFrame:
    """Per (keys, window): always keep errors / compute events; other
    allowed events while fewer than ``cap`` events were kept before them
    (equivalently: rank among candidates <= cap)."""
    always = F.col("is_error") | F.coalesce(F.col("is_compute"), F.lit(False)) \
        if "is_compute" in events.columns else F.col("is_error")
    c = (events.withColumn("period", F.window("ts", window).start)
         .withColumn("_always", always)
         .filter(F.col("_always") | F.col("allowed")))
    if cap <= 0:
        return c.drop("_always")
    r = rank_in_group(c, list(keys) + ["period"], ["ts", "seq"], bucket="1 minute", out_col="_rn")
    return r.filter(F.col("_always") | (F.col("_rn") <= cap)).drop("_always", "_rn")
