"""Budget queries.  Budgets are derived from ``part``: one budget per brand,
bound to an environment and module by the brand number, threshold = mean part
size (integer), active unless the brand number is a multiple of 5.  A batch is
a one-hour window of an environment's profiler / orm / sql events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import budgets as bo
from vantage.operators.windows import interval_us
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

BATCH_WINDOW = "1 hour"
COOLDOWN = "6 hours"
TREND_NOW = "2024-01-31 00:00:00"


def budgets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return (p.withColumn("_n", n)
            .groupBy("p_brand", "_n")
            .agg(F.min("p_type").alias("endpoint"),
                 F.floor(F.sum("p_size") / F.count(F.lit(1))).cast("int").alias("threshold_pct"))
            .select(F.col("p_brand").alias("budget_id"),
                    F.concat(F.lit("env"), (F.col("_n") % 3).cast("string")).alias("env_id"),
                    F.concat(F.lit("mod"), (F.col("_n") % 4).cast("string")).alias("module"),
                    "endpoint", "threshold_pct", (F.col("_n") % 5 != 0).alias("is_active")))


def batch_events(spark, sf_dir):
    return bo.batches(telemetry_events(spark, sf_dir), BATCH_WINDOW)


def samples(spark, sf_dir):
    return bo.overhead_samples(bo.module_stats(batch_events(spark, sf_dir)), budgets(spark, sf_dir))


_W = interval_us(BATCH_WINDOW)
_BASE = "WITH RECURSIVE " + EVENTS_CTE_SQL + f""",
bud AS (
  SELECT p_brand AS budget_id, 'env' || CAST(n % 3 AS VARCHAR) AS env_id, 'mod' || CAST(n % 4 AS VARCHAR) AS module,
         min(p_type) AS endpoint, CAST(sum(p_size) // count(*) AS INTEGER) AS threshold_pct, n % 5 <> 0 AS is_active
  FROM (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part)
  GROUP BY p_brand, n),
be AS (SELECT *, make_timestamp(epoch_us(ts) // {_W} * {_W}) AS period FROM ev
       WHERE category IN ('profiler', 'orm', 'sql')),
tot AS (SELECT env_id, period, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM be GROUP BY 1, 2),
mods AS (
  SELECT env_id, period, module, CAST(sum(duration_ms) AS BIGINT) AS module_ms,
         CAST(sum(CASE WHEN category = 'sql' THEN duration_ms ELSE 0 END) AS BIGINT) AS sql_ms,
         count(*) FILTER (WHERE category = 'sql') AS sql_count,
         CAST(sum(CASE WHEN category = 'orm' THEN duration_ms ELSE 0 END) AS BIGINT) AS orm_ms,
         count(*) FILTER (WHERE category = 'orm') AS orm_count,
         CAST(sum(CASE WHEN category IN ('python', 'profiler') THEN duration_ms ELSE 0 END) AS BIGINT) AS python_ms
  FROM be WHERE coalesce(module, '') <> '' GROUP BY 1, 2, 3),
samples AS (
  SELECT m.*, t.total_ms, b.budget_id, b.endpoint, b.threshold_pct,
         CASE WHEN t.total_ms = 0 THEN 0.0
              ELSE floor((m.module_ms * 20000 + t.total_ms) / (2 * t.total_ms)) / 100.0 END AS overhead_pct,
         m.module_ms * 100 > CAST(b.threshold_pct AS BIGINT) * t.total_ms AS breach
  FROM mods m JOIN tot t USING (env_id, period)
  JOIN (SELECT * FROM bud WHERE is_active) b USING (env_id, module)
  WHERE t.total_ms > 0)"""


@query("module_overhead", _BASE + "\nSELECT * FROM samples", ops="A11 A13 J7 F12")
def q_module_overhead(spark, sf_dir):
    return samples(spark, sf_dir)


@query("overhead_breakdown", _BASE + """,
f AS (SELECT env_id, period, module, model, method, category, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
             count(*) AS call_count
      FROM be WHERE coalesce(module, '') <> '' AND (coalesce(model, '') <> '' OR coalesce(method, '') <> '')
      GROUP BY ALL),
mt AS (SELECT env_id, period, module, CAST(sum(duration_ms) AS BIGINT) AS mod_ms FROM be
       WHERE coalesce(module, '') <> '' GROUP BY ALL)
SELECT f.*, CASE WHEN mt.mod_ms = 0 THEN 0.0
                 ELSE floor((f.duration_ms * 20000 + mt.mod_ms) / (2 * mt.mod_ms)) / 100.0 END AS pct,
       row_number() OVER (PARTITION BY f.env_id, f.period, f.module
                          ORDER BY f.duration_ms DESC, f.model, f.method, f.category) - 1 AS pos
FROM f JOIN mt USING (env_id, period, module)""", ops="A12")
def q_overhead_breakdown(spark, sf_dir):
    return bo.function_breakdown(batch_events(spark, sf_dir))


@query("budget_trend", _BASE + f""",
agg AS (SELECT budget_id, CAST(sum(round(overhead_pct * 100)) AS BIGINT) AS sh, count(*) AS n,
               max(overhead_pct) AS mx
        FROM samples WHERE period > TIMESTAMP '{TREND_NOW}' - INTERVAL 7 DAY GROUP BY 1)
SELECT b.budget_id, coalesce(floor((sh * 2 + n) / (2 * n)) / 100.0, 0.0) AS avg_overhead,
       coalesce(mx, 0.0) AS max_overhead, coalesce(n, 0) AS sample_count
FROM bud b LEFT JOIN agg USING (budget_id)""", ops="A5")
def q_budget_trend(spark, sf_dir):
    return bo.budget_trend(samples(spark, sf_dir), budgets(spark, sf_dir), TREND_NOW)


_C = interval_us(COOLDOWN)


@query("budget_alerts", _BASE + f""",
br AS (SELECT * FROM samples WHERE breach),
nx AS (SELECT b1.*, (SELECT min(b2.period) FROM br b2 WHERE b2.env_id = b1.env_id AND b2.module = b1.module
                       AND b2.budget_id = b1.budget_id
                       AND epoch_us(b2.period) >= epoch_us(b1.period) + {_C}) AS next_t FROM br b1),
kept AS (SELECT env_id, module, budget_id, min(period) AS period FROM br GROUP BY 1, 2, 3
         UNION ALL
         SELECT nx.env_id, nx.module, nx.budget_id, nx.next_t FROM kept
         JOIN nx ON nx.env_id = kept.env_id AND nx.module = kept.module AND nx.budget_id = kept.budget_id
                AND nx.period = kept.period
         WHERE nx.next_t IS NOT NULL),
tenths AS (SELECT br.*, (module_ms * 1000) // total_ms AS q, (module_ms * 1000) % total_ms AS r
           FROM br JOIN kept USING (env_id, module, budget_id, period)),
t2 AS (SELECT *, CASE WHEN r * 2 > total_ms THEN q + 1 WHEN r * 2 = total_ms AND q % 2 = 1 THEN q + 1
                      ELSE q END AS q2 FROM tenths)
SELECT env_id, budget_id, module, period AS created_at, 'budget_exceeded' AS type,
       CASE WHEN threshold_pct > 0 AND module_ms * 200 >= CAST(threshold_pct AS BIGINT) * 3 * total_ms
            THEN 'critical' ELSE 'warning' END AS severity,
       printf('Module ''%s'' exceeded performance budget: %s%% overhead (threshold: %d%%)', module,
              CAST(q2 // 10 AS VARCHAR) || '.' || CAST(q2 % 10 AS VARCHAR), threshold_pct) AS message,
       overhead_pct - threshold_pct AS exceeded_by
FROM t2""", ops="W9 C5 R19")
def q_budget_alerts(spark, sf_dir):
    return bo.budget_alerts(samples(spark, sf_dir), COOLDOWN)
