"""Error queries: grouping, spike / re-open alerts, search, signatures.

Status changes for W11 are derived from ``orders`` (an order is a status
action on the error group of its customer's user): F -> resolved,
P -> acknowledged, O -> open, at a time spread over the event month.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import errors as fe
from vantage.operators import errors as eo
from vantage.plans.registry import query
from vantage.sources.tables import EVENTS_CTE_SQL, table, telemetry_events

SPIKE_THRESHOLD = 5
SEARCH_TERM = "M2_"
EPOCH_2024 = 1704067200


def _errs(spark, sf_dir):
    return eo.error_events(telemetry_events(spark, sf_dir))


def status_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    u = o.o_custkey % 150
    return o.select(
        F.concat(F.lit("env"), (u % 3).cast("string")).alias("env_id"),
        F.concat(F.lit("error:mod"), (o.o_orderkey % 4).cast("string"), F.lit(":m"), u.cast("string"),
                 F.lit(":error")).alias("signature"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + (o.o_orderkey * 7919) % 2592000).alias("ts"),
        o.o_orderkey.alias("seq"),
        F.when(o.o_orderstatus == "F", "resolved").when(o.o_orderstatus == "P", "acknowledged")
        .otherwise("open").alias("status"))


def _users_text(df):
    return df.withColumn("affected_users", F.array_join(F.col("affected_users").cast("array<string>"), ","))


_ERR_CTE = "WITH " + EVENTS_CTE_SQL + """,
err AS (
  SELECT env_id, seq, ts,
         concat_ws(':', category, nullif(module, ''), nullif(model, ''), nullif(method, '')) AS signature,
         CASE WHEN coalesce(category, '') <> '' THEN category ELSE 'Error' END AS error_type,
         substr(category, 1, 2000) AS message,
         nullif(module, '') AS module, nullif(model, '') AS model,
         CASE WHEN user_id > 0 THEN user_id END AS user_id
  FROM ev WHERE is_error),
groups AS (
  SELECT env_id, signature, count(*) AS occurrence_count,
         first(ts ORDER BY seq) AS first_seen, last(ts ORDER BY seq) AS last_seen,
         last(message ORDER BY seq) AS message, first(error_type ORDER BY seq) AS error_type,
         first(module ORDER BY seq) AS module, first(model ORDER BY seq) AS model,
         coalesce(array_to_string(list_sort(list_distinct(list(user_id) FILTER (WHERE user_id IS NOT NULL))), ','),
                  '') AS affected_users
  FROM err GROUP BY 1, 2)"""

_CHANGES_CTE = f""",
changes AS (
  SELECT 'env' || CAST(o_custkey % 150 % 3 AS VARCHAR) AS env_id,
         'error:mod' || CAST(o_orderkey % 4 AS VARCHAR) || ':m' || CAST(o_custkey % 150 AS VARCHAR) || ':error'
           AS signature,
         make_timestamp(({EPOCH_2024} + (o_orderkey * 7919) % 2592000) * 1000000) AS ts,
         o_orderkey AS seq,
         CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END AS status
  FROM orders)"""


@query("error_groups", _ERR_CTE + "\nSELECT * FROM groups", ops="A21 A22 C16b")
def q_error_groups(spark, sf_dir):
    return _users_text(eo.group_errors(_errs(spark, sf_dir)))


@query("error_spike", _ERR_CTE + f"""
SELECT env_id, signature, seq, ts, rn AS occurrence_count, 'error_spike' AS type, 'warning' AS severity,
       printf('%s: %d occurrences of %s', error_type, rn, substr(signature, 1, 8)) AS message
FROM (SELECT *, row_number() OVER (PARTITION BY env_id, signature ORDER BY ts, seq) AS rn FROM err)
WHERE rn = {SPIKE_THRESHOLD}""", ops="W10")
def q_error_spike(spark, sf_dir):
    return eo.spike_alerts(_errs(spark, sf_dir), SPIKE_THRESHOLD)


@query("error_reopen", _ERR_CTE + _CHANGES_CTE + """,
occ AS (SELECT env_id, signature, ts, seq, 1 AS kind, CAST(NULL AS VARCHAR) AS status,
               row_number() OVER (PARTITION BY env_id, signature ORDER BY ts, seq) AS occurrence_count
        FROM err),
u AS (SELECT * FROM occ UNION ALL
      SELECT env_id, signature, ts, seq, 0 AS kind, status, CAST(NULL AS BIGINT) FROM changes),
p AS (SELECT *, lag(kind) OVER w AS prev_kind, lag(status) OVER w AS prev_status FROM u
      WINDOW w AS (PARTITION BY env_id, signature ORDER BY ts, kind, seq))
SELECT env_id, signature, seq, ts, occurrence_count, 'error_reopen' AS type, 'critical' AS severity,
       printf('Resolved error re-fired: %s (%d total occurrences)', substr(signature, 1, 40), occurrence_count)
         AS message
FROM p WHERE kind = 1 AND prev_kind = 0 AND prev_status IN ('resolved', 'acknowledged')""", ops="W11 U2")
def q_error_reopen(spark, sf_dir):
    return eo.reopen_alerts(_errs(spark, sf_dir), status_changes(spark, sf_dir))


@query("error_search", _ERR_CTE + f"""
SELECT * FROM groups
WHERE coalesce(message ILIKE '%' || '{SEARCH_TERM}' || '%', false)
   OR coalesce(module ILIKE '%' || '{SEARCH_TERM}' || '%', false)
   OR coalesce(model ILIKE '%' || '{SEARCH_TERM}' || '%', false)""", ops="F3")
def q_error_search(spark, sf_dir):
    return _users_text(eo.search_groups(eo.group_errors(_errs(spark, sf_dir)), SEARCH_TERM))


# ----------------------------------------------------------- text signatures
WS_SQL = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def _first_line_sql(x: str) -> str:
    return (f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_trim_sql('l')}), "
            f"lambda l: l <> '')[1], {x})")


def _normalize_sql(x: str) -> str:
    pats = [
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*",
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        r"\b[0-9a-fA-F]{8,}\b",
        r"(?:^|[^a-zA-Z_])(\d+)(?:[^a-zA-Z_]|$)",
    ]
    s = _first_line_sql(x)
    for p in pats:
        s = f"regexp_replace({s}, '{p}', '<?>', 'g')"
    s = f"regexp_replace({s}, '(?:<\\?>)+', '<?>', 'g')"
    return _trim_sql(f"regexp_replace({s}, '{WS_SQL}+', ' ', 'g')")


def _error_type_sql(x: str) -> str:
    m = _trim_sql(x)
    last = _trim_sql(f"string_split({m}, chr(10))[-1]")
    ident = f"regexp_extract({last}, '^([A-Za-z0-9_.]+): ', 1)"
    return f"CASE WHEN {m} = '' THEN 'UnknownError' WHEN {ident} <> '' THEN {ident} ELSE {last} END"


@query("normalize_message", f"""
SELECT doc_id, {_normalize_sql('text')} AS normalized FROM documents""", ops="C15")
def q_normalize_message(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", fe.normalize_message("text").alias("normalized"))


@query("error_signature", f"""
SELECT doc_id, error_type,
       substr(sha256(concat_ws(chr(0), error_type, {_normalize_sql('text')})), 1, 16) AS signature,
       substr(sha256(error_type || ':' || {_first_line_sql('text')}), 1, 16) AS legacy_signature
FROM (SELECT doc_id, text, {_error_type_sql('text')} AS error_type FROM documents)""",
       ops="C12 C13 C14 C15 C16 C16b")
def q_error_signature(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = d.withColumn("error_type", fe.error_type("text"))
    return t.select("doc_id", "error_type",
                    fe.error_signature(F.col("error_type"), F.col("text"), fe.extract_traceback(F.col("text")))
                    .alias("signature"),
                    fe.legacy_signature(F.col("error_type"), F.col("text")).alias("legacy_signature"))


