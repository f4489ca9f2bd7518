"""Profiler waterfalls and sampled profiles.

A *recording* is a key (e.g. env + window) over profiler events.  Spans,
lanes and summaries are per-recording windows / aggregates.  Compute chains
(R17, J14, A19) are in ``compute``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.functions.scoring import pct_hundredths
from vantage.functions.sqltext import cut_text
from vantage.operators.compute import compute_chain, compute_depths, compute_edges, compute_stats  # noqa: F401

CATEGORY_LABELS = {  # fixed display labels
    "sql": "SQL Queries", "orm": "ORM Calls", "python": "Python Execution",
    "rpc": "RPC Calls", "http": "HTTP Requests",
}


def _cols(xs: Sequence[str]) -> list[Column]:
    return [F.col(x) for x in xs]


def event_label(model="model", method="method", sql="sql", category="category") -> Column:
    """Model.method, else model, else SQL (60 chars + '...'), else category."""
    m, me, s = F.coalesce(F.col(model), F.lit("")), F.coalesce(F.col(method), F.lit("")), F.coalesce(F.col(sql), F.lit(""))
    return (F.when((m != "") & (me != ""), F.concat(m, F.lit("."), me))
            .when(m != "", m)
            .when(s != "", cut_text(s, 60, "..."))
            .otherwise(F.col(category)))


def category_label(cat: Column) -> Column:
    e = F.when(F.lit(False), F.lit(None))
    for k, v in CATEGORY_LABELS.items():
        e = e.when(cat == k, F.lit(v))
    return e.otherwise(cat)


def waterfall_spans(events: DataFrame, rec_keys: Sequence[str], bucket: str = "1 minute") -> DataFrame:
    """R16 + W8 + W12: spans in timestamp order (seq breaks ties), start offset
    in whole ms from the first event, label, default category python, SQL cut
    at 200 chars + '...'.

    A recording may be large, so neither the ordinal nor the offset sorts a
    whole recording in one task: the ordinal comes from ``rank_in_group``
    (time-bucketed) and the first timestamp from a partial ``min`` joined
    back on the recording key."""
    from vantage.operators.windows import rank_in_group
    rec_keys = list(rec_keys)
    first = events.groupBy(*rec_keys).agg(F.min(F.unix_micros("ts")).alias("_first_us"))
    ranked = rank_in_group(events, rec_keys, ["ts", "seq"], bucket=bucket, out_col="_rank")
    e = ranked.join(first, rec_keys)
    cat = F.when(F.coalesce(F.col("category"), F.lit("")) == "", F.lit("python")).otherwise(F.col("category"))
    pos = F.col("_rank") - 1
    return e.select(
        *rec_keys,
        F.concat(F.lit("span-"), pos.cast("string")).alias("span_id"),
        pos.cast("long").alias("pos"),
        event_label().alias("label"), cat.alias("category"),
        F.col("duration_ms").alias("ms"),
        F.floor((F.unix_micros("ts") - F.col("_first_us")) / 1000).cast("long").alias("start_ms"),
        "model", "method", "module",
        cut_text(F.coalesce(F.col("sql"), F.lit("")), 200, "...").alias("sql"),
        "is_n1", "is_error", "seq", F.coalesce(F.col("sql"), F.lit("")).alias("full_sql"))


def waterfall_lanes(spans: DataFrame, rec_keys: Sequence[str]) -> DataFrame:
    """Per (recording, category) total ms, pct of the recording total
    (denominator 1 when 0), label, position by ms desc."""
    rec_keys = list(rec_keys)
    lanes = spans.groupBy(*rec_keys, "category").agg(F.sum(F.col("ms").cast("long")).alias("total_ms"))
    w = Window.partitionBy(*_cols(rec_keys))
    tot = F.sum("total_ms").over(w)
    denom = F.when(tot == 0, F.lit(1)).otherwise(tot)
    return (lanes.withColumn("pct", pct_hundredths("total_ms", denom))
            .withColumn("label", category_label(F.col("category")))
            .withColumn("pos", (F.row_number().over(w.orderBy(F.col("total_ms").desc(), "category")) - 1).cast("long")))


def waterfall_summary(spans: DataFrame, rec_keys: Sequence[str]) -> DataFrame:
    """A15 + A16: totals by category, N+1 and error counts, and the SQL of the
    slowest SQL span (first in span order on ties, '' unless > 0 ms)."""
    rec_keys = list(rec_keys)
    ms = F.col("ms").cast("long")
    cat = F.col("category")
    sql_key = F.when(cat == "sql", F.struct(ms.alias("ms"), (-F.col("pos")).alias("neg_pos")))
    return (spans.groupBy(*rec_keys)
            .agg(F.sum(ms).alias("total_ms"), F.count(F.lit(1)).alias("span_count"),
                 F.sum(F.when(cat == "sql", ms).otherwise(0)).alias("sql_ms"),
                 F.count_if(cat == "sql").alias("sql_count"),
                 F.sum(F.when(cat == "orm", ms).otherwise(0)).alias("orm_ms"),
                 F.count_if(cat == "orm").alias("orm_count"),
                 F.sum(F.when(cat == "python", ms).otherwise(0)).alias("python_ms"),
                 F.count_if(F.col("is_n1")).alias("n1_count"),
                 F.sum(F.when(F.col("is_n1"), ms).otherwise(0)).alias("n1_ms"),
                 F.count_if(F.col("is_error")).alias("error_count"),
                 F.max(F.when(cat == "sql", ms)).alias("_max_sql"),
                 F.max_by(F.col("sql"), sql_key).alias("_crit")))\
        .withColumn("critical_sql", F.when(F.col("_max_sql") > 0, F.col("_crit")).otherwise(F.lit("")))\
        .drop("_max_sql", "_crit")


def recording_patterns(spans: DataFrame, rec_keys: Sequence[str]) -> DataFrame:
    """N+1 patterns of each recording: per (model, method) count, ms and
    the whole SQL of the first flagged span."""
    rec_keys = list(rec_keys)
    return (spans.filter(F.col("is_n1"))
            .groupBy(*rec_keys, "model", "method")
            .agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("ms").cast("long")).alias("total_ms"),
                 F.min_by("full_sql", F.col("pos")).alias("sql")))


# ------------------------------------------------------ sampled profiles

COMPUTE_PREFIXES = ("_compute_", "_inverse_")
UNIT_SCALE = {"nanoseconds": 1e6, "microseconds": 1e3}


def is_compute_method(name: Column) -> Column:
    return name.startswith(COMPUTE_PREFIXES[0]) | name.startswith(COMPUTE_PREFIXES[1])


def explode_speedscope(docs: DataFrame, id_col: str = "profile_id") -> tuple[DataFrame, DataFrame]:
    """Nested speedscope documents -> (frames, samples) rows.

    frames: (id, frame_idx, name, file); samples: (id, type, unit, sample_idx,
    stack, weight) where a missing weight is NULL (counted as 0)."""
    frames = docs.select(id_col, F.posexplode("frames").alias("frame_idx", "f")).select(
        id_col, F.col("frame_idx").cast("string").alias("frame_idx"), F.col("f.name").alias("name"),
        F.col("f.file").alias("file"))
    prof = docs.select(id_col, F.posexplode("profiles").alias("p_idx", "p"))
    samples = prof.select(id_col, "p_idx", F.col("p.type").alias("type"), F.col("p.unit").alias("unit"),
                          (F.col("p.endValue") - F.col("p.startValue")).alias("duration"),
                          F.col("p.weights").alias("weights"),
                          F.posexplode("p.samples").alias("sample_idx", "stack"))
    samples = samples.select(id_col, "p_idx", "type", "unit", "duration", "sample_idx",
                             F.transform("stack", lambda x: x.cast("string")).alias("stack"),
                             F.get(F.col("weights"), F.col("sample_idx")).alias("weight"))
    return frames, samples


def frame_time(frames: DataFrame, samples: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """Per profile and compute method name: sum of sample weights over
    every occurrence of the frame in a stack, converted to ms by unit,
    truncated per frame, summed by name, at least 1 ms.  Only ``sampled``
    profiles count.  ``profile_duration_ms`` = int(sum of end - start)."""
    s = samples.filter(F.col("type") == "sampled")
    occ = s.select(id_col, "unit", F.explode("stack").alias("frame_idx"),
                   F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"))
    cf = frames.filter(is_compute_method(F.col("name")))
    # name and file travel with the frame through one join
    j = occ.join(cf, [id_col, "frame_idx"])
    per_unit = j.groupBy(id_col, "frame_idx", "name", "file", "unit").agg(F.sum("weight").alias("w"))
    scale = (F.when(F.lower(F.col("unit")) == "nanoseconds", F.lit(1e6))
             .when(F.lower(F.col("unit")) == "microseconds", F.lit(1e3)).otherwise(F.lit(1.0)))
    named = (per_unit.withColumn("_ms", F.col("w") / scale)
             .groupBy(id_col, "frame_idx", "name", "file").agg(F.sum("_ms").alias("_ms"))
             .withColumn("ms", F.floor(F.col("_ms")).cast("long")))
    dur = (s.select(id_col, "p_idx", "duration").distinct()
           .groupBy(id_col).agg(F.floor(F.sum("duration")).cast("long").alias("profile_duration_ms")))
    return (named.groupBy(id_col, "name")
            .agg(F.sum("ms").alias("duration_ms"), F.min("file").alias("source_file"))
            .withColumn("duration_ms", F.greatest(F.col("duration_ms"), F.lit(1)))
            .withColumnRenamed("name", "method_name")
            .join(dur, id_col, "left"))


# ------------------------------------------------- stored waterfalls

SPAN_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("ms", T.IntegerType()), T.StructField("duration_ms", T.IntegerType()),
    T.StructField("start_ms", T.IntegerType()), T.StructField("model", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("module", T.StringType()),
    T.StructField("sql", T.StringType()), T.StructField("is_n1", T.BooleanType()),
    T.StructField("is_error", T.BooleanType()), T.StructField("parent_id", T.StringType()),
]))
PATTERN_SCHEMA = T.ArrayType(T.StructType([T.StructField("model", T.StringType()),
                                           T.StructField("method", T.StringType())]))


def infer_category(label: Column) -> Column:
    """Category from a span label (unknown -> python)."""
    return (F.when(label.isin("SQL", "sql"), "sql").when(label.isin("ORM", "orm"), "orm")
            .when(label.isin("RPC", "rpc"), "rpc").when(label.isin("HTTP", "http"), "http")
            .otherwise("python"))


def stored_spans(recordings: DataFrame, rec: str = "rec", waterfall_col: str = "waterfall",
                 n1_col: str = "n1_patterns") -> DataFrame:
    """N1 + N2 + W7 + W14: unnest stored waterfall JSON.  The detailed format
    (any span with a start or a category) keeps explicit timing; the simple
    format lays spans out back to back (running sum).  Malformed or empty JSON
    gives no spans.  N+1 is also set from the recording's pattern list."""
    spans = F.coalesce(F.from_json(F.col(waterfall_col), SPAN_SCHEMA), F.array().cast(SPAN_SCHEMA))
    keys = F.transform(F.coalesce(F.from_json(F.col(n1_col), PATTERN_SCHEMA), F.array().cast(PATTERN_SCHEMA)),
                       lambda p: F.concat_ws(":", p["model"], p["method"]))
    detailed = F.exists(spans, lambda s: (F.coalesce(s["start_ms"], F.lit(0)) > 0)
                        | (F.coalesce(s["category"], F.lit("")) != ""))
    d = recordings.select(rec, detailed.alias("_detailed"), keys.alias("_n1keys"),
                          F.posexplode(spans).alias("pos", "s"))
    s = F.col("s")
    ms, dur = F.coalesce(s["ms"], F.lit(0)), F.coalesce(s["duration_ms"], F.lit(0))
    cat = F.when(F.col("_detailed") & (F.coalesce(s["category"], F.lit("")) != ""), s["category"]) \
        .otherwise(infer_category(F.coalesce(s["label"], F.lit(""))))
    duration = F.when(F.col("_detailed"), F.when(dur != 0, dur).otherwise(ms)).otherwise(F.when(ms != 0, ms).otherwise(dur))
    model, method = F.coalesce(s["model"], F.lit("")), F.coalesce(s["method"], F.lit(""))
    label = (F.when(F.coalesce(s["label"], F.lit("")) != "", s["label"])
             .when((model != "") & (method != ""), F.concat(model, F.lit("."), method))
             .when(model != "", model).otherwise(cat))
    is_n1 = F.coalesce(s["is_n1"], F.lit(False)) | F.array_contains(F.col("_n1keys"), F.concat(model, F.lit(":"), method))
    out = d.select(rec, "pos", "_detailed", F.concat(F.lit("span-"), F.col("pos").cast("string")).alias("span_id"),
                   cat.alias("category"), label.alias("label"), duration.alias("duration_ms"),
                   F.coalesce(s["start_ms"], F.lit(0)).alias("_start"), s["module"].alias("module"),
                   model.alias("model"), method.alias("method"),
                   cut_text(F.coalesce(s["sql"], F.lit("")), 200, "...").alias("sql"), is_n1.alias("is_n1"),
                   F.coalesce(s["is_error"], F.lit(False)).alias("is_error"),
                   F.coalesce(s["parent_id"], F.lit("")).alias("parent_id"))
    w = Window.partitionBy(rec).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("duration_ms").over(w), F.lit(0)).cast("int")
    out = (out.withColumn("start_ms", F.when(F.col("_detailed"), F.col("_start")).otherwise(offset))
           .withColumn("depth", F.when(F.col("_detailed") & (F.col("parent_id") != ""), 1).otherwise(0)))
    order = Window.partitionBy(rec).orderBy("start_ms", "depth", "pos")
    return out.withColumn("order", F.row_number().over(order) - 1).drop("_detailed", "_start")
