"""Profiler queries.

Waterfall recordings are one-hour windows of an environment's profiler / orm
/ sql events (with N+1 flags).  Compute chains are derived from ``lineitem``:
an order is a recording, a line is a compute node on field ``f<line>`` of
model ``m<partkey % 2>`` that depends on the fields ``f<suppkey % line>`` and
``f<partkey % line>``, processed in ship-date order.  Sampled profiles for A20
are derived from events: one profile per (env, hour), one sample per event.

Compute events (R18) take the same profiles with eight variants of each ORM method;
nations are the field index: nation n is field ``f<n>`` of model ``m<n % 5>`` and depends on
three others, one of them of another model.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.operators import listings as lo
from vantage.operators import profiles as po
from vantage.operators.compute import profile_events
from vantage.operators.budgets import batches
from vantage.operators.windows import interval_us
from vantage.plans.registry import REGISTRY, query
from vantage.session import written
from vantage.plans.telemetry import _n1_cte, flagged_events
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

REC_WINDOW = "1 hour"
REC = ["env_id", "period"]


def rec_events(spark, sf_dir):
    return batches(flagged_events(spark, sf_dir), REC_WINDOW)


def spans(spark, sf_dir):
    return po.waterfall_spans(rec_events(spark, sf_dir), REC)


_W = interval_us(REC_WINDOW)
_REC_SQL = "WITH " + EVENTS_CTE_SQL + _n1_cte() + f""",
be AS (SELECT *, make_timestamp(epoch_us(ts) // {_W} * {_W}) AS period FROM n1
       WHERE category IN ('profiler', 'orm', 'sql')),
spans AS (
  SELECT env_id, period,
         'span-' || CAST(row_number() OVER (PARTITION BY env_id, period ORDER BY ts, seq) - 1 AS VARCHAR) AS span_id,
         row_number() OVER (PARTITION BY env_id, period ORDER BY ts, seq) - 1 AS pos,
         CASE WHEN coalesce(model, '') <> '' AND coalesce(method, '') <> '' THEN model || '.' || method
              WHEN coalesce(model, '') <> '' THEN model
              WHEN coalesce(sql, '') <> '' THEN CASE WHEN length(sql) > 60 THEN substr(sql, 1, 60) || '...' ELSE sql END
              ELSE category END AS label,
         CASE WHEN coalesce(category, '') = '' THEN 'python' ELSE category END AS category,
         duration_ms AS ms,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY env_id, period)) // 1000 AS start_ms,
         model, method, module,
         CASE WHEN length(coalesce(sql, '')) > 200 THEN substr(sql, 1, 200) || '...' ELSE coalesce(sql, '') END AS sql,
         is_n1, is_error, seq, coalesce(sql, '') AS full_sql
  FROM be)"""


@query("waterfall_spans", _REC_SQL + "\nSELECT * EXCLUDE (full_sql) FROM spans", ops="R16 W8 W12 C18 C19")
def q_waterfall_spans(spark, sf_dir):
    return spans(spark, sf_dir).drop("full_sql")


@query("waterfall_lanes", _REC_SQL + """,
l AS (SELECT env_id, period, category, CAST(sum(ms) AS BIGINT) AS total_ms FROM spans GROUP BY ALL),
t AS (SELECT *, sum(total_ms) OVER (PARTITION BY env_id, period) AS tot FROM l)
SELECT env_id, period, category, total_ms,
       floor((total_ms * 20000 + (CASE WHEN tot = 0 THEN 1 ELSE tot END))
             / (2 * (CASE WHEN tot = 0 THEN 1 ELSE tot END))) / 100.0 AS pct,
       CASE category WHEN 'sql' THEN 'SQL Queries' WHEN 'orm' THEN 'ORM Calls' WHEN 'python' THEN 'Python Execution'
                     WHEN 'rpc' THEN 'RPC Calls' WHEN 'http' THEN 'HTTP Requests' ELSE category END AS label,
       row_number() OVER (PARTITION BY env_id, period ORDER BY total_ms DESC, category) - 1 AS pos
FROM t""", ops="A14")
def q_waterfall_lanes(spark, sf_dir):
    return po.waterfall_lanes(spans(spark, sf_dir), REC)


@query("waterfall_summary", _REC_SQL + """
SELECT env_id, period, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS span_count,
       CAST(sum(CASE WHEN category = 'sql' THEN ms ELSE 0 END) AS BIGINT) AS sql_ms,
       count(*) FILTER (WHERE category = 'sql') AS sql_count,
       CAST(sum(CASE WHEN category = 'orm' THEN ms ELSE 0 END) AS BIGINT) AS orm_ms,
       count(*) FILTER (WHERE category = 'orm') AS orm_count,
       CAST(sum(CASE WHEN category = 'python' THEN ms ELSE 0 END) AS BIGINT) AS python_ms,
       count(*) FILTER (WHERE is_n1) AS n1_count,
       CAST(sum(CASE WHEN is_n1 THEN ms ELSE 0 END) AS BIGINT) AS n1_ms,
       count(*) FILTER (WHERE is_error) AS error_count,
       CASE WHEN max(CASE WHEN category = 'sql' THEN ms END) > 0
            THEN first(sql ORDER BY ms DESC, pos) FILTER (WHERE category = 'sql') ELSE '' END AS critical_sql
FROM spans GROUP BY 1, 2""", ops="A15 A16")
def q_waterfall_summary(spark, sf_dir):
    return po.waterfall_summary(spans(spark, sf_dir), REC)


@query("recording_patterns", _REC_SQL + """
SELECT env_id, period, model, method, count(*) AS count, CAST(sum(ms) AS BIGINT) AS total_ms,
       first(full_sql ORDER BY pos) AS sql
FROM spans WHERE is_n1 GROUP BY ALL""", ops="A17")
def q_recording_patterns(spark, sf_dir):
    return po.recording_patterns(spans(spark, sf_dir), REC)


# ------------------------------------------------------------ compute chains

NODE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"]


def compute_nodes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                                 "l_returnflag", "l_shipdate").withColumn("rec", F.col("l_orderkey").cast("string"))
    ln = F.col("l_linenumber")
    deps = F.when(ln > 1, F.array(F.concat(F.lit("f"), (F.col("l_suppkey") % ln).cast("string")),
                                  F.concat(F.lit("f"), (F.col("l_partkey") % ln).cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    w = Window.partitionBy("rec").orderBy(*NODE_ORDER)  # by the key that recordings are packed by: dealt out once
    return li.select(
        "rec",
        (F.row_number().over(w) - 1).cast("int").alias("idx"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 2).cast("string")).alias("model"),
        F.concat(F.lit("f"), ln.cast("string")).alias("field_name"),
        F.concat(F.lit("_compute_f"), ln.cast("string")).alias("method"),
        F.col("l_quantity").cast("int").alias("duration_ms"),
        deps.alias("depends_on"),
        F.when(F.col("l_returnflag") == "R", "qty").when(F.col("l_returnflag") == "A", "price")
        .otherwise("").alias("trigger_field"))


def chain(spark, sf_dir):
    return po.compute_chain(compute_nodes(spark, sf_dir))


_CHAIN_SQL = """WITH RECURSIVE
nodes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS rec,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
                                              l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS idx,
         'm' || CAST(l_partkey % 2 AS VARCHAR) AS model, 'f' || CAST(l_linenumber AS VARCHAR) AS field_name,
         '_compute_f' || CAST(l_linenumber AS VARCHAR) AS method, CAST(l_quantity AS INTEGER) AS duration_ms,
         CASE WHEN l_linenumber > 1 THEN ['f' || CAST(l_suppkey % l_linenumber AS VARCHAR),
                                          'f' || CAST(l_partkey % l_linenumber AS VARCHAR)]
              ELSE CAST([] AS VARCHAR[]) END AS depends_on,
         CASE l_returnflag WHEN 'R' THEN 'qty' WHEN 'A' THEN 'price' ELSE '' END AS trigger_field
  FROM lineitem),
nd AS (SELECT rec, idx, model, unnest(depends_on) AS dep, unnest(range(1, len(depends_on) + 1)) AS j FROM nodes),
e AS (SELECT nd.rec, nd.idx, nd.j, p.idx AS p_idx FROM nd
      JOIN nodes p ON p.rec = nd.rec AND p.model = nd.model AND p.field_name = nd.dep AND p.idx < nd.idx),
paths AS (SELECT rec, idx, 0 AS depth FROM nodes
          UNION ALL
          SELECT e.rec, e.idx, paths.depth + 1 FROM paths JOIN e ON e.rec = paths.rec AND e.p_idx = paths.idx),
dep AS (SELECT rec, idx, max(depth) AS depth FROM paths GROUP BY 1, 2),
ej AS (SELECT e.rec, e.idx, e.j, max(d.depth) AS mdj, max(e.p_idx) AS pid
       FROM e JOIN dep d ON d.rec = e.rec AND d.idx = e.p_idx GROUP BY 1, 2, 3),
par AS (SELECT ej.rec, ej.idx, 'compute-' || CAST(first(ej.pid ORDER BY ej.j) AS VARCHAR) AS parent_id
        FROM ej JOIN dep me ON me.rec = ej.rec AND me.idx = ej.idx
        WHERE ej.mdj = me.depth - 1 GROUP BY 1, 2),
chain AS (SELECT n.rec, n.idx, 'compute-' || CAST(n.idx AS VARCHAR) AS node_id, n.model, n.field_name, n.method,
                 n.duration_ms, n.depends_on, n.trigger_field, CAST(d.depth AS INTEGER) AS depth,
                 coalesce(p.parent_id, '') AS parent_id
          FROM nodes n JOIN dep d USING (rec, idx) LEFT JOIN par p USING (rec, idx))"""


@query("compute_depth", _CHAIN_SQL + """
SELECT rec, idx, node_id, model, field_name, method, duration_ms, array_to_string(depends_on, ',') AS depends_on,
       trigger_field, depth, parent_id FROM chain""", ops="R17 W12")
def q_compute_depth(spark, sf_dir):
    return chain(spark, sf_dir).withColumn("depends_on", F.array_join("depends_on", ","))


@query("compute_edges", _CHAIN_SQL + """,
fidx AS (SELECT rec, model, field_name, last(node_id ORDER BY idx) AS src FROM chain GROUP BY 1, 2, 3)
SELECT rec, parent_id AS src, node_id AS dst, coalesce(trigger_field, '') AS trigger_field, 'parent' AS kind
FROM chain WHERE parent_id <> ''
UNION ALL
SELECT c.rec, f.src, c.node_id AS dst, c.dep AS trigger_field, 'depends' AS kind
FROM (SELECT rec, model, node_id, unnest(depends_on) AS dep FROM chain) c
JOIN fidx f ON f.rec = c.rec AND f.model = c.model AND f.field_name = c.dep
WHERE f.src <> c.node_id""", ops="J14")
def q_compute_edges(spark, sf_dir):
    return po.compute_edges(written(chain(spark, sf_dir)))  # read by three branches


@query("compute_stats", _CHAIN_SQL + """,
g AS (SELECT rec, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS node_count, max(depth) AS max_depth,
             first(node_id ORDER BY duration_ms DESC, idx) AS slowest_node, max(duration_ms) AS slowest_ms,
             coalesce(first(trigger_field ORDER BY idx) FILTER (WHERE depth = 0 AND coalesce(trigger_field, '') <> ''),
                      '') AS trigger_field
      FROM chain GROUP BY 1),
b AS (SELECT c.rec, count(*) FILTER (WHERE c.duration_ms >= greatest((g.total_ms // g.node_count) * 2, 10))
             AS bottleneck_count
      FROM chain c JOIN g USING (rec) GROUP BY 1)
SELECT g.rec, total_ms, node_count, max_depth,
       CASE WHEN slowest_ms > 0 THEN slowest_node ELSE '' END AS slowest_node,
       greatest(slowest_ms, 0) AS slowest_ms, trigger_field, bottleneck_count
FROM g JOIN b USING (rec)""", ops="A19")
def q_compute_stats(spark, sf_dir):
    return po.compute_stats(po.compute_depths(compute_nodes(spark, sf_dir)))


# ------------------------------------------------------- sampled profiles
# One profile per (env, hour); one sample per profiler / orm / sql event with
# stack [dispatch, frame] (the frame twice when k % 5 = 0).  ORM events run a
# '_compute_<method>_<k % 3>' frame, SQL events '_inverse_<method>', others a
# plain method frame.  Units by environment: ns, us, ms.

def profile_rows(spark, sf_dir, variants=3):
    ev = batches(telemetry_events(spark, sf_dir), REC_WINDOW)
    pid = F.concat(F.col("env_id"), F.lit("@"), (F.unix_micros("period") / 1000000).cast("long").cast("string"))
    name = (F.when(F.col("category") == "orm",
                   F.concat(F.lit("_compute_"), F.col("method"), F.lit("_"), (F.col("k") % variants).cast("string")))
            .when(F.col("category") == "sql", F.concat(F.lit("_inverse_"), F.col("method")))
            .otherwise(F.col("method")))
    file = F.concat(F.lit("addons/"), F.col("module"), F.lit("/models/"), F.col("model"), F.lit(".py"))
    unit = (F.when(F.col("env_id") == "env0", "nanoseconds").when(F.col("env_id") == "env1", "microseconds")
            .otherwise("milliseconds"))
    weight = (F.when(F.col("env_id") == "env0", F.round(F.col("value") * 1e6))
              .when(F.col("env_id") == "env1", F.round(F.col("value") * 1e3))
              .otherwise(F.floor("value").cast("double")))
    dur = (F.when(F.col("env_id") == "env0", F.lit(3.6e12)).when(F.col("env_id") == "env1", F.lit(3.6e9))
           .otherwise(F.lit(3.6e6)))
    r = ev.select(pid.alias("profile_id"), name.alias("name"), file.alias("file"), unit.alias("unit"),
                  weight.alias("weight"), dur.alias("duration"), "k", "category", "seq")
    key = F.concat(F.col("name"), F.lit("|"), F.col("file"))
    frames = r.select("profile_id", key.alias("frame_idx"), "name", "file").unionByName(
        r.select("profile_id", F.lit("dispatch|").alias("frame_idx"), F.lit("dispatch").alias("name"),
                 F.lit("").alias("file"))).distinct()
    stack = F.when(F.col("k") % 5 == 0, F.array(F.lit("dispatch|"), key, key)).otherwise(F.array(F.lit("dispatch|"), key))
    samples = r.select("profile_id", F.lit(0).alias("p_idx"),
                       F.when(F.col("category") == "error", "evented").otherwise("sampled").alias("type"),
                       "unit", "duration", F.col("seq").alias("sample_idx"), stack.alias("stack"), "weight")
    return frames, samples


@query("profile_frame_time", "WITH " + EVENTS_CTE_SQL + f""",
pe AS (
  SELECT env_id || '@' || CAST(epoch_us(ts) // {_W} * {_W} // 1000000 AS VARCHAR) AS profile_id,
         CASE category WHEN 'orm' THEN '_compute_' || method || '_' || CAST(k % 3 AS VARCHAR)
                       WHEN 'sql' THEN '_inverse_' || method ELSE method END AS name,
         'addons/' || module || '/models/' || model || '.py' AS file,
         CASE env_id WHEN 'env0' THEN round(value * 1000000.0) WHEN 'env1' THEN round(value * 1000.0)
                     ELSE CAST(floor(value) AS DOUBLE) END AS weight,
         CASE env_id WHEN 'env0' THEN 1000000.0 WHEN 'env1' THEN 1000.0 ELSE 1.0 END AS scale,
         CASE env_id WHEN 'env0' THEN 3.6e12 WHEN 'env1' THEN 3.6e9 ELSE 3.6e6 END AS duration,
         CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS occ
  FROM ev WHERE category IN ('profiler', 'orm', 'sql')),
pf AS (SELECT profile_id, name, file, floor(sum(weight * occ) / any_value(scale)) AS ms FROM pe
       WHERE name LIKE '\\_compute\\_%' ESCAPE '\\' OR name LIKE '\\_inverse\\_%' ESCAPE '\\'
       GROUP BY 1, 2, 3),
pd AS (SELECT profile_id, CAST(floor(any_value(duration)) AS BIGINT) AS profile_duration_ms FROM pe GROUP BY 1)
SELECT profile_id, name AS method_name, greatest(CAST(sum(ms) AS BIGINT), 1) AS duration_ms,
       min(file) AS source_file, profile_duration_ms
FROM pf JOIN pd USING (profile_id) GROUP BY profile_id, name, profile_duration_ms""", ops="A20 SRC(speedscope)")
def q_profile_frame_time(spark, sf_dir):
    frames, samples = profile_rows(spark, sf_dir)
    return po.frame_time(frames, samples)


# ------------------------------------------------------- compute events

VARIANTS = 8


def event_index(spark, sf_dir):
    n = F.col("n_nationkey")
    ref = lambda e: F.concat(F.lit("f"), (e % 25).cast("string"))
    records = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("m"), (n % 5).cast("string")).alias("model"), ref(n).alias("name"),
        F.concat(F.lit("_compute_"), F.when(n % 2 == 0, "click_").otherwise("signup_"), (n * 3 % VARIANTS).cast("string")).alias("compute"),
        F.concat_ws(", ", ref(n + 15), ref(n + 5), ref(n + 1)).alias("depends"), F.lit("base,sale").alias("modules"))
    return lo.field_index(records.filter(n % 7 != 3))


_EVENT_SQL = REGISTRY["profile_frame_time"].sql.replace("CAST(k % 3 AS VARCHAR)", f"CAST(k % {VARIANTS} AS VARCHAR)")


@query("profile_events", f"""
WITH RECURSIVE fr AS ({_EVENT_SQL}),
idx AS (
  SELECT '_compute_' || CASE n_nationkey % 2 WHEN 0 THEN 'click_' ELSE 'signup_' END || CAST(n_nationkey * 3 % {VARIANTS} AS VARCHAR)
           AS method_name, 'm' || CAST(n_nationkey % 5 AS VARCHAR) AS model, 'f' || CAST(n_nationkey AS VARCHAR) AS field_name,
         ['f' || CAST((n_nationkey + 15) % 25 AS VARCHAR), 'f' || CAST((n_nationkey + 5) % 25 AS VARCHAR),
          'f' || CAST((n_nationkey + 1) % 25 AS VARCHAR)] AS depends_on
  FROM nation WHERE n_nationkey % 7 <> 3),
fm AS (SELECT profile_id, method_name, model, field_name, depends_on FROM fr JOIN idx USING (method_name)),
needs AS (SELECT profile_id, method_name, model, field_name, unnest(depends_on) AS dep, unnest([1, 2, 3]) AS at FROM fm),
edges AS (
  SELECT n.profile_id, n.method_name, o.method_name AS source, n.model, n.field_name, n.at
  FROM needs n JOIN fm o ON o.profile_id = n.profile_id AND o.model = n.model AND o.field_name = n.dep
  WHERE o.method_name <> n.method_name),
paths AS (
  SELECT DISTINCT profile_id, method_name, 1 AS depth FROM edges
  UNION
  SELECT e.profile_id, e.method_name, p.depth + 1
  FROM paths p JOIN edges e ON e.profile_id = p.profile_id AND e.source = p.method_name AND e.source < e.method_name),
depths AS (SELECT profile_id, method_name, max(depth) AS depth FROM paths GROUP BY 1, 2),
parents AS (
  SELECT e.profile_id, e.method_name,
         first(e.source ORDER BY CASE WHEN e.source < e.method_name THEN coalesce(d.depth, 0) ELSE 0 END DESC,
                                 e.model, e.field_name, e.at) AS parent_method
  FROM edges e LEFT JOIN depths d ON d.profile_id = e.profile_id AND d.method_name = e.source GROUP BY 1, 2),
firsts AS (SELECT method_name, first(model || '.' || field_name ORDER BY model, field_name) AS f FROM idx GROUP BY 1),
roots AS (
  SELECT profile_id, first(f ORDER BY method_name) AS root_field
  FROM fr JOIN firsts USING (method_name) LEFT JOIN depths USING (profile_id, method_name) WHERE depth IS NULL GROUP BY 1)
SELECT fr.profile_id, 'profiler' AS category, coalesce(idx.model, 'profile ' || fr.profile_id) AS model, fr.method_name AS method,
       CASE WHEN idx.model IS NULL THEN split_part(source_file, '/', 2) ELSE 'base' END AS module, duration_ms, true AS is_compute,
       coalesce(idx.field_name, '') AS field_name, coalesce(array_to_string(idx.depends_on, ','), '') AS depends_on,
       coalesce(pf.f, root_field, '') AS trigger_field, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth,
       coalesce(parent_method, '') AS parent_method,
       make_timestamp(CAST(split_part(fr.profile_id, '@', 2) AS BIGINT) * 1000000) AS ts
FROM fr LEFT JOIN idx USING (method_name) LEFT JOIN depths d ON d.profile_id = fr.profile_id AND d.method_name = fr.method_name
LEFT JOIN parents p ON p.profile_id = fr.profile_id AND p.method_name = fr.method_name
LEFT JOIN firsts pf ON pf.method_name = p.parent_method LEFT JOIN roots ON roots.profile_id = fr.profile_id""", ops="R18 A20 J13 C21")
def q_profile_events(spark, sf_dir):
    frames, samples = profile_rows(spark, sf_dir, VARIANTS)
    profiles = frames.select("profile_id").distinct().select(
        "profile_id", F.concat(F.lit("profile "), "profile_id").alias("name"),
        F.timestamp_seconds(F.substring_index("profile_id", "@", -1).cast("long")).alias("created"))
    timed = po.frame_time(frames, samples).withColumn("source_file", F.concat(F.lit("/srv/"), "source_file"))
    events = profile_events(profiles, timed, event_index(spark, sf_dir))
    return events.withColumn("depends_on", F.array_join("depends_on", ","))
