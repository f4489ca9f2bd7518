"""SQL-text scalars (C1, C6, C7, C10) as Column -> Column expressions.

All are built-in regex / string functions so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Literals replaced by '?': single-quoted strings, whole integers.
SQL_LITERAL_PATTERN = r"(?:'[^']*'|\b\d+\b)"
# Primary table after FROM / INTO / UPDATE, quoted (log variant).
TABLE_QUOTED_PATTERN = r'(?i)(?:FROM|INTO|UPDATE)\s+"(\w+)"'
# Query-statistics variant: also JOIN, quotes optional.
TABLE_LOOSE_PATTERN = r'(?i)(?:FROM|INTO|UPDATE|JOIN)\s+"?(\w+)"?'
# C10: "4.2ms SELECT ..." and "query: SELECT ..." message forms.
MODELS_QUERY_PATTERN = r"^(\d+(?:\.\d+)?)ms\s+(.+)$"
SQLDB_QUERY_PATTERN = r"^query:\s+(.+)$"

_WS_EDGES = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(s) -> Column:
    """Trim all leading / trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(s), _WS_EDGES, "")


def normalize_sql(s) -> Column:
    """Trim, then replace quoted strings and whole integers by '?'."""
    return F.regexp_replace(strip_ws(s), SQL_LITERAL_PATTERN, "?")


def table_to_model(t: Column) -> Column:
    return F.translate(t, "_", ".")


def model_from_sql(s) -> Column:
    """C6 (log variant): first quoted FROM/INTO/UPDATE table, '_' -> '.'; '' if none."""
    return table_to_model(F.regexp_extract(_c(s), TABLE_QUOTED_PATTERN, 1))


def model_from_stat_sql(s) -> Column:
    """C6 (query-statistics variant): JOIN too, quotes optional, system tables skipped."""
    t = F.regexp_extract(_c(s), TABLE_LOOSE_PATTERN, 1)
    return (F.when(t.startswith("pg_") | t.startswith("information_"), F.lit(""))
            .otherwise(table_to_model(t)))


def _verb(u: Column) -> Column:
    return (F.when(u.startswith("SELECT"), "read")
            .when(u.startswith("INSERT"), "create")
            .when(u.startswith("UPDATE"), "write")
            .when(u.startswith("DELETE"), "unlink")
            .otherwise("unknown"))


def sql_method(s, min_length: int = 6) -> Column:
    """SQL verb -> ORM method.  The log variant requires >= 6 characters
    (pass ``min_length=0`` for the query-statistics variant)."""
    t = strip_ws(s)
    v = _verb(F.upper(t))
    if min_length:
        return F.when(F.length(t) < min_length, F.lit("unknown")).otherwise(v)
    return v


def parse_query_message(logger, message, continuation=None) -> Column:
    """struct(duration_ms int, sql string, ok boolean) from a query log message.

    ``odoo.models.query`` messages carry '<ms>ms <sql>', ``odoo.sql_db`` ones
    'query: <sql>' (no duration).  Continuation lines are appended with spaces.
    """
    lg, msg = _c(logger), _c(message)
    is_models = lg == "odoo.models.query"
    is_sqldb = lg == "odoo.sql_db"
    m_ok = msg.rlike(MODELS_QUERY_PATTERN)
    s_ok = msg.rlike(SQLDB_QUERY_PATTERN)
    ok = (is_models & m_ok) | (is_sqldb & s_ok)
    sql = (F.when(is_models, F.regexp_extract(msg, MODELS_QUERY_PATTERN, 2))
           .when(is_sqldb, F.regexp_extract(msg, SQLDB_QUERY_PATTERN, 1)))
    if continuation is not None:
        cont = _c(continuation)
        sql = F.when(F.coalesce(cont, F.lit("")) != "",
                     F.concat(sql, F.lit(" "), F.regexp_replace(cont, "\n", " "))).otherwise(sql)
    dur = F.when(is_models, F.regexp_extract(msg, MODELS_QUERY_PATTERN, 1).cast("double").cast("int")) \
           .otherwise(F.lit(0))
    return F.struct(F.coalesce(dur, F.lit(0)).alias("duration_ms"), sql.alias("sql"), ok.alias("ok"))


def truncate_text(s, max_len: int, suffix: str = "...") -> Column:
    """Keep ``max_len - len(suffix)`` characters plus suffix when longer."""
    c = _c(s)
    keep = max_len - len(suffix) if suffix else max_len
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, keep), F.lit(suffix))).otherwise(c)


def cut_text(s, n: int, suffix: str = "...") -> Column:
    """First ``n`` characters plus ``suffix`` when longer than ``n``."""
    c = _c(s)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)
