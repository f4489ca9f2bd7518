"""Report queries over earlier results: cross-recording N+1 merge (A18),
last-N log view with a level filter after the limit (W5, F9, SNK3), snapshot
diff (J19), schema search (N5) and the orphan-object manifest (U6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.operators import tables as to
from vantage.operators.logs import LOG_HEADER_PATTERN
from vantage.operators.windows import keep_newest
from vantage.plans import logs as pl
from vantage.plans import profiles as pp
from vantage.plans import tables as pt
from vantage.plans import upgrade as pu
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table

RECENT_RECORDINGS = 100
TAIL_LINES = 1000
SEARCH_TERM = "account"


@query("n1_recording_merge", pp._REC_SQL + f""",
pat AS (SELECT env_id, period, model, method, count(*) AS cnt, CAST(sum(ms) AS BIGINT) AS total_ms,
               first(full_sql ORDER BY pos) AS sql
        FROM spans WHERE is_n1 GROUP BY ALL),
rec AS (SELECT env_id, period FROM (
          SELECT env_id, period, row_number() OVER (PARTITION BY env_id ORDER BY period DESC) AS rn
          FROM (SELECT DISTINCT env_id, period FROM pat)) WHERE rn <= {RECENT_RECORDINGS})
SELECT env_id, model, method, CAST(sum(cnt) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms,
       coalesce(first(sql ORDER BY period DESC) FILTER (WHERE coalesce(sql, '') <> ''), '') AS sample_sql
FROM pat JOIN rec USING (env_id, period) GROUP BY ALL""", ops="A18 A10 T7")
def q_n1_recording_merge(spark, sf_dir):
    from vantage.operators.profiles import recording_patterns
    pat = recording_patterns(pp.spans(spark, sf_dir), pp.REC)
    recent = keep_newest(pat.select("env_id", "period").distinct(), ["env_id"], [F.col("period").desc()],
                         RECENT_RECORDINGS)
    j = pat.join(recent, ["env_id", "period"])
    first_sql = F.max_by(F.col("sql"), F.when(F.coalesce(F.col("sql"), F.lit("")) != "", F.col("period")))
    return (j.groupBy("env_id", "model", "method")
            .agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), first_sql.alias("sample_sql"))
            .withColumn("sample_sql", F.coalesce(F.col("sample_sql"), F.lit(""))))


@query("log_tail", pl._LINES_SQL + f""",
tl AS (SELECT split_part(file, '/', 1) AS env_id, file, line_no, value,
              row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY file DESC, line_no DESC) AS rn
       FROM lines),
kept AS (SELECT env_id, file, line_no, value,
                row_number() OVER (PARTITION BY env_id ORDER BY file, line_no) - 1 AS pos
         FROM tl WHERE rn <= {TAIL_LINES})
SELECT env_id, pos, file, line_no, value FROM kept, PAT
WHERE regexp_extract(value, PAT.p, 3) IN ('ERROR', 'CRITICAL')""", ops="W5 F9 SNK3")
def q_log_tail(spark, sf_dir):
    ln = pl.log_lines(spark, sf_dir).withColumn("env_id", F.substring_index("file", "/", 1))
    w = Window.partitionBy("env_id").orderBy(F.col("file").desc(), F.col("line_no").desc())
    kept = ln.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= TAIL_LINES).drop("_rn")
    w2 = Window.partitionBy("env_id").orderBy("file", "line_no")
    kept = kept.withColumn("pos", (F.row_number().over(w2) - 1).cast("long"))
    lvl = F.regexp_extract("value", LOG_HEADER_PATTERN, 3)
    return kept.filter(lvl.isin("ERROR", "CRITICAL")).select("env_id", "pos", "file", "line_no", "value")


@query("schema_diff", "WITH " + pu._IDX_SQL.lstrip() + """,
a AS (SELECT DISTINCT model, field FROM idx WHERE env_id = 'env0'),
b AS (SELECT DISTINCT model, field FROM idx WHERE env_id = 'env1')
SELECT coalesce(a.model, b.model) AS model, coalesce(a.field, b.field) AS field,
       CASE WHEN a.model IS NULL THEN 'added' ELSE 'removed' END AS change
FROM a FULL OUTER JOIN b ON a.model = b.model AND a.field = b.field
WHERE a.model IS NULL OR b.model IS NULL""", ops="J19")
def q_schema_diff(spark, sf_dir):
    idx = pu.schema_index(spark, sf_dir)
    a = idx.filter(F.col("env_id") == "env0").select("model", "field").distinct().alias("a")
    b = idx.filter(F.col("env_id") == "env1").select("model", "field").distinct().alias("b")
    j = a.join(b, (F.col("a.model") == F.col("b.model")) & (F.col("a.field") == F.col("b.field")), "full_outer")
    return (j.filter(F.col("a.model").isNull() | F.col("b.model").isNull())
            .select(F.coalesce(F.col("a.model"), F.col("b.model")).alias("model"),
                    F.coalesce(F.col("a.field"), F.col("b.field")).alias("field"),
                    F.when(F.col("a.model").isNull(), "added").otherwise("removed").alias("change")))


@query("schema_search", "WITH " + pu._IDX_SQL.lstrip() + f""",
m AS (SELECT env_id, model, count(field) AS field_count FROM (SELECT DISTINCT env_id, model, field FROM idx)
      WHERE contains(lower(model), '{SEARCH_TERM}') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY model) AS rn, count(*) OVER (PARTITION BY env_id) AS total
      FROM m)
SELECT env_id, model, field_count, total, rn - 1 AS row_in_page FROM r WHERE rn <= 50""", ops="N5 T2 T7")
def q_schema_search(spark, sf_dir):
    idx = pu.schema_index(spark, sf_dir).distinct()
    m = (idx.filter(F.lower("model").contains(SEARCH_TERM))
         .groupBy("env_id", "model").agg(F.count("field").alias("field_count")))
    p = to.page(m, ["env_id"], [F.col("model")], 1, to.clamp_limit(50, 50, 1, 100))
    return p.select("env_id", "model", "field_count", "total", "row_in_page")


@query("orphan_refs", f"""
WITH pol AS (
  SELECT n_nationkey AS tenant_id,
         coalesce(nullif(CASE WHEN n_nationkey % 7 = 3 THEN -1 ELSE (n_nationkey % 4) * 400 END, 0), 7) AS d
  FROM nation),
r AS (SELECT o.o_orderkey, o.o_orderdate, c.c_nationkey AS tenant_id
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT DISTINCT 'traces/' || CAST(r.tenant_id AS VARCHAR) || '/' || CAST(r.o_orderkey AS VARCHAR) || '.json.gz'
         AS raw_trace_ref
FROM r JOIN pol p USING (tenant_id)
WHERE p.d > 0 AND r.o_orderdate < TIMESTAMP '{pt.NOW}' - p.d * INTERVAL 1 DAY""", ops="U6 U4")
def q_orphan_refs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                F.col("c_nationkey").alias("tenant_id"))
    rows = o.join(c, "o_custkey")
    pol = pt._policies(spark, sf_dir).select("tenant_id", "error_traces_days")
    j = rows.join(pol, "tenant_id")
    cutoff = F.lit(pt.NOW).cast("timestamp") - F.make_interval(days=F.col("error_traces_days"))
    expired = j.filter((F.col("error_traces_days") > 0) & (F.col("o_orderdate").cast("timestamp") < cutoff))
    ref = F.concat(F.lit("traces/"), F.col("tenant_id").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"),
                   F.lit(".json.gz"))
    return to.orphan_refs(expired.withColumn("raw_trace_ref", ref), "raw_trace_ref")


# ------------------------------------------------- incremental pulls, stat scans

PULL_HWM, PULL_LIMIT = 5000, 200


@query("error_pull", "WITH " + EVENTS_CTE_SQL + f"""
SELECT seq, ts, env_id, model, method FROM ev WHERE is_error AND seq > {PULL_HWM} ORDER BY seq LIMIT {PULL_LIMIT}""",
       ops="SRC2 T4 F13")
def q_error_pull(spark, sf_dir):
    from vantage.sources.incremental import pull_since
    from vantage.sources.tables import telemetry_events
    ev = telemetry_events(spark, sf_dir).filter(F.col("is_error")).select("seq", "ts", "env_id", "model", "method")
    batch, _ = pull_since(ev, "seq", PULL_HWM, PULL_LIMIT)
    return batch


_STAT_QUERY_SQL = """
CASE method WHEN 'view' THEN sql WHEN 'click' THEN 'BEGIN' WHEN 'error' THEN 'rollback'
            WHEN 'purchase' THEN 'SET LOCAL statement_timeout = ' || CAST(k AS VARCHAR)
            ELSE 'SHOW ' || method END"""


@query("stat_scan", "WITH " + EVENTS_CTE_SQL + f""",
s AS (SELECT env_id, {_STAT_QUERY_SQL} AS query, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
             max(duration_ms) AS max_ms FROM ev GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE query NOT LIKE 'SET %' AND query NOT LIKE 'SHOW %' AND query NOT LIKE 'RESET %'
        AND query NOT LIKE 'DEALLOCATE %' AND NOT regexp_matches(query, '(?i)^(BEGIN|COMMIT|ROLLBACK)'))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY total_ms DESC, query) AS rank FROM f)
WHERE rank <= 500""", ops="SRC3 F4 T1")
def q_stat_scan(spark, sf_dir):
    from vantage.sources.incremental import stat_snapshot_scan
    from vantage.sources.tables import telemetry_events
    ev = telemetry_events(spark, sf_dir)
    m = F.col("method")
    q = (F.when(m == "view", F.col("sql")).when(m == "click", F.lit("BEGIN")).when(m == "error", F.lit("rollback"))
         .when(m == "purchase", F.concat(F.lit("SET LOCAL statement_timeout = "), F.col("k").cast("string")))
         .otherwise(F.concat(F.lit("SHOW "), m)))
    stats = (ev.withColumn("query", q).groupBy("env_id", "query")
             .agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("duration_ms").cast("long")).alias("total_ms"),
                  F.max("duration_ms").alias("max_ms")))
    return stat_snapshot_scan(stats)
