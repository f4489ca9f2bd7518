"""Access-control queries.

Bindings (derived from the driver tables, no collect):
* groups: nation n is group 10+n, region r is group 100+r.  Implication edges:
  nation -> its region, nation n -> nation n div 2 (n >= 1), region r ->
  region (r+1) mod 5 (a cycle), and group 34 -> 999 (an unknown id).
* users: customers (uid = custkey; inactive when acctbal <= -800; company =
  nation mod 5; direct groups [10 + nation], plus 101 when custkey mod 11 = 0).
* requests: one per order: the user, model and operation are derived from the
  order key; the order row is the record the domains are evaluated on.
The rule catalogs below are configuration (fixed values of this binding).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import access as ac
from vantage.operators import access_rules as ar
from vantage.plans.registry import query
from vantage.sources.tables import table

SCHEMA_MODELS = ("res.users", "res.partner", "sale.order", "stock.move")
ACCESS_RULES = (
    ac.AccessRule("sale.order", "100", True, True, True, False),
    ac.AccessRule("sale.order", "101", True, False, True, False),
    ac.AccessRule("sale.order", "102", True, True, False, False),
    ac.AccessRule("sale.order", "103", True, False, False, False),
    ac.AccessRule("sale.order", "104", True, True, False, True),
    ac.AccessRule("res.partner", "", True, False, False, False),
)
RECORD_RULES = (
    ac.RecordRule("sale.order", "known statuses", (),
                  "['|', ('o_orderstatus', '=', 'O'), ('o_orderstatus', 'in', ['F', 'P'])]"),
    ac.RecordRule("sale.order", "own orders", (100, 101), "[('o_custkey', '=', user.id)]",
                  perm_read=True, perm_write=True),
    ac.RecordRule("sale.order", "big urgent", (102, 103, 104),
                  "[('o_orderpriority', '=like', '1-%'), ('o_totalprice', '>=', 150000)]", perm_read=True),
    ac.RecordRule("sale.order", "not finished", (20, 21, 22), "['!', ('o_orderstatus', '=', 'F')]",
                  perm_write=True, perm_unlink=True),
    ac.RecordRule("sale.order", "company partner", (101,),
                  "[('o_custkey', 'in', company_ids), ('partner_id.name', 'ilike', 'x')]", perm_create=True),
    ac.RecordRule("sale.order", "price sanity", (),
                  "[('o_totalprice', '>', 0), ('o_orderpriority', 'not ilike', '%low%')]", perm_unlink=True),
)
ORDER_FIELDS = {"o_orderkey": "num", "o_custkey": "num", "o_orderstatus": "str", "o_totalprice": "num",
                "o_orderpriority": "str"}


def group_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey")
    e1 = n.select((F.col("n_nationkey") + 10).alias("group_id"), (F.col("n_regionkey") + 100).alias("implied_id"))
    e2 = n.filter(F.col("n_nationkey") >= 1).select((F.col("n_nationkey") + 10).alias("group_id"),
                                                     (F.floor(F.col("n_nationkey") / 2) + 10).cast("int").alias("implied_id"))
    e3 = r.select((F.col("r_regionkey") + 100).alias("group_id"),
                  (F.col("r_regionkey") + 1) % 5 + 100).toDF("group_id", "implied_id")
    e4 = n.filter(F.col("n_nationkey") == 24).select(F.lit(34).alias("group_id"), F.lit(999).alias("implied_id"))
    return e1.unionByName(e2).unionByName(e3).unionByName(e4).select(
        F.col("group_id").cast("int"), F.col("implied_id").cast("int"))


def users(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    g = F.when(F.col("c_custkey") % 11 == 0, F.array((F.col("c_nationkey") + 10).cast("int"), F.lit(101))) \
        .otherwise(F.array((F.col("c_nationkey") + 10).cast("int")))
    return c.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("login"),
                    (F.col("c_acctbal") > -800).alias("active"),
                    (F.col("c_nationkey") % 5).cast("int").alias("company_id"),
                    F.array((F.col("c_nationkey") % 5).cast("int"), ((F.col("c_nationkey") + 1) % 5).cast("int"))
                    .alias("company_ids"), g.alias("group_ids"))


def user_groups(spark, sf_dir):
    return ac.effective_groups(users(spark, sf_dir), ac.group_closure(group_edges(spark, sf_dir)))


def requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderpriority")
    k = F.col("o_orderkey")
    uid = (F.when(k % 50 == 7, F.col("o_custkey") + 100000000).when(k % 3 == 0, F.col("o_custkey"))
           .otherwise(F.col("o_custkey") % 100 + 1))
    model = F.when(k % 10 == 9, "account.move").when(k % 10 == 8, "stock.move").otherwise("sale.order")
    op = (F.when(k % 4 == 0, "read").when(k % 4 == 1, "write").when(k % 4 == 2, "create").otherwise("unlink"))
    return o.select(k.alias("request_id"), uid.alias("uid"), model.alias("model"), op.alias("op"), "o_orderkey",
                    "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_EDGES_SQL = """
edges AS (
  SELECT n_nationkey + 10 AS a, n_regionkey + 100 AS b FROM nation
  UNION ALL SELECT n_nationkey + 10, CAST(n_nationkey // 2 + 10 AS INTEGER) FROM nation WHERE n_nationkey >= 1
  UNION ALL SELECT r_regionkey + 100, (r_regionkey + 1) % 5 + 100 FROM region
  UNION ALL SELECT 34, 999 FROM nation WHERE n_nationkey = 24),
clo AS (SELECT a, b FROM edges UNION SELECT clo.a, edges.b FROM clo JOIN edges ON clo.b = edges.a),
u AS (SELECT c_custkey AS uid, c_acctbal > -800 AS active, c_nationkey % 5 AS company_id,
             [c_nationkey % 5, (c_nationkey + 1) % 5] AS company_ids,
             CASE WHEN c_custkey % 11 = 0 THEN [c_nationkey + 10, 101] ELSE [c_nationkey + 10] END AS group_ids
      FROM customer),
dg AS (SELECT uid, unnest(group_ids) AS g FROM u),
eg AS (SELECT uid, g FROM dg UNION SELECT dg.uid, clo.b FROM dg JOIN clo ON clo.a = dg.g),
ue AS (SELECT u.*, coalesce((SELECT list_sort(list(DISTINCT eg.g)) FROM eg WHERE eg.uid = u.uid), []) AS effective
       FROM u)"""


@query("group_closure", "WITH RECURSIVE " + _EDGES_SQL + """
SELECT uid, array_to_string(effective, ',') AS effective,
       array_to_string(list_sort(list_filter(effective, lambda x: NOT list_contains(group_ids, x))), ',') AS implied
FROM ue""", ops="J20 X1 R5")
def q_group_closure(spark, sf_dir):
    g = user_groups(spark, sf_dir)
    return g.select("uid", F.array_join("effective", ",").alias("effective"),
                    F.array_join("implied", ",").alias("implied"))


ACCESS_SCHEMA = "model string, pos int, group_id string, perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean"
RECORD_SCHEMA = ("model string, pos int, name string, group_ids array<int>, domain string, "
                 "perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean")


def rule_frames(spark):
    """The catalogs above as tables, in the order they are written in."""
    access = [(r.model, i, r.group_id, r.perm_read, r.perm_write, r.perm_create, r.perm_unlink) for i, r in enumerate(ACCESS_RULES)]
    record = [(r.model, i, r.name, list(r.group_ids), r.domain, r.perm_read, r.perm_write, r.perm_create, r.perm_unlink)
              for i, r in enumerate(RECORD_RULES)]
    models = spark.createDataFrame([(m,) for m in SCHEMA_MODELS + ("res.groups",)], "model string")
    return models, spark.createDataFrame(access, ACCESS_SCHEMA), spark.createDataFrame(record, RECORD_SCHEMA)


def with_users(req, spark, sf_dir):
    """Requests with their users, effective groups and record."""
    ug = user_groups(spark, sf_dir).select("uid", "login", "active", "company_id", "company_ids", "effective",
                                           F.size("group_ids").alias("n_direct"), F.lit(True).alias("user_found"))
    return req.join(ug, "uid", "left").withColumn("record", ar.record_of(ORDER_FIELDS))


STAGE_NAMES = {"user": "s1_user", "groups": "s2_groups", "model_acl": "s3_model_acl", "record_rule": "s4_record_rules", "domain": "s5_domain"}


def trace(spark, sf_dir):
    t = ar.trace(with_users(requests(spark, sf_dir), spark, sf_dir), *rule_frames(spark))
    failing = F.coalesce(*[F.when(F.col("failing_stage") == k, F.lit(v)) for k, v in STAGE_NAMES.items()])
    return t.select("request_id", "uid", "model", "op", F.col("v1").alias("s1_user"), F.col("v2").alias("s2_groups"),
                    F.col("v3").alias("s3_model_acl"), F.col("v4").alias("s4_record_rules"),
                    F.col("v5").alias("s5_domain"), failing.alias("failing_stage"), "verdict")


# ------------------------------------------------------- DuckDB twin of R6-R10
# each domain of RECORD_RULES written out by hand

_PRICE = "CAST(r.o_totalprice AS DOUBLE)"
DOMAIN_SQL = {
    "known statuses": "(coalesce(r.o_orderstatus = 'O', false) OR coalesce(r.o_orderstatus IN ('F', 'P'), false))",
    "own orders": "coalesce(r.o_custkey = r.uid, false)",
    "big urgent": f"(coalesce(r.o_orderpriority LIKE '1-%', false) AND coalesce({_PRICE} - 150000 > -1e-9, true))",
    "not finished": "(NOT coalesce(r.o_orderstatus = 'F', false))",
    "company partner": "false",  # its second field does not exist
    "price sanity": f"(coalesce({_PRICE} >= 1e-9, false) AND NOT coalesce(r.o_orderpriority ILIKE '%low%', false))",
}


def _trace_sql():
    def perm(rule):
        return (f"CASE r.op WHEN 'read' THEN {str(rule.perm_read).lower()} WHEN 'write' THEN "
                f"{str(rule.perm_write).lower()} WHEN 'create' THEN {str(rule.perm_create).lower()} "
                f"WHEN 'unlink' THEN {str(rule.perm_unlink).lower()} ELSE false END")

    def ingrp(g):
        return f"coalesce(list_contains(r.effective, {int(g)}), false)"

    grant = []
    for m in sorted({a.model for a in ACCESS_RULES}):
        terms = [f"(({'true' if a.group_id in ('', '0') else ingrp(a.group_id)}) AND {perm(a)})"
                 for a in ACCESS_RULES if a.model == m]
        grant.append(f"WHEN r.model = '{m}' THEN ({' OR '.join(terms)})")
    has_acc = ", ".join(f"'{m}'" for m in sorted({a.model for a in ACCESS_RULES}))
    in_schema = ", ".join(f"'{m}'" for m in SCHEMA_MODELS)
    s3 = (f"CASE WHEN r.model NOT IN ({in_schema}) THEN 'ERROR' WHEN r.model NOT IN ({has_acc}) THEN 'DENIED' "
          f"WHEN (CASE {' '.join(grant)} ELSE false END) THEN 'OK' ELSE 'DENIED' END")
    s4p, s5p = [], []
    for m in sorted({x.model for x in RECORD_RULES}):
        rules = [x for x in RECORD_RULES if x.model == m]
        total, gex, gap, glob, gany = [], [], [], [], []
        for x in rules:
            allf = not (x.perm_read or x.perm_write or x.perm_create or x.perm_unlink)
            cov = "true" if allf else perm(x)
            dom = DOMAIN_SQL[x.name]
            total.append(f"CAST({cov} AS INTEGER)")
            if not x.group_ids:
                glob.append(f"(NOT ({cov}) OR {dom})")
            else:
                app = f"(({cov}) AND ({' OR '.join(ingrp(g) for g in x.group_ids)}))"
                gex.append(f"({cov})")
                gap.append(app)
                gany.append(f"({app} AND {dom})")
        tot = " + ".join(total)
        ge = " OR ".join(gex) or "false"
        ga = " OR ".join(gap) or "false"
        s4p.append(f"WHEN r.model = '{m}' THEN CASE WHEN ({tot}) = 0 THEN 'SKIPPED' "
                   f"WHEN ({ge}) AND NOT ({ga}) THEN 'DENIED' ELSE 'OK' END")
        s5p.append(f"WHEN r.model = '{m}' THEN CASE WHEN ({' AND '.join(glob) or 'true'}) AND "
                   f"(NOT ({ga}) OR ({' OR '.join(gany) or 'false'})) THEN 'OK' ELSE 'DENIED' END")
    s4 = f"CASE WHEN r.model NOT IN ({in_schema}) THEN 'ERROR' {' '.join(s4p)} ELSE 'SKIPPED' END"
    s5 = f"CASE {' '.join(s5p)} ELSE 'OK' END"
    s1 = "CASE WHEN NOT coalesce(r.user_found, false) THEN 'DENIED' WHEN NOT r.active THEN 'DENIED' ELSE 'OK' END"
    return "WITH RECURSIVE " + _EDGES_SQL + f""",
rq AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderkey % 50 = 7 THEN o_custkey + 100000000 WHEN o_orderkey % 3 = 0 THEN o_custkey
              ELSE o_custkey % 100 + 1 END AS uid,
         CASE o_orderkey % 10 WHEN 9 THEN 'account.move' WHEN 8 THEN 'stock.move' ELSE 'sale.order' END AS model,
         CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'create' ELSE 'unlink' END AS op,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
  FROM orders),
r AS (SELECT rq.*, ue.active, ue.company_id, ue.company_ids, ue.effective, ue.uid IS NOT NULL AS user_found
      FROM rq LEFT JOIN ue USING (uid)),
t1 AS (SELECT r.request_id, r.uid, r.model, r.op, {s1} AS s1_user, {s3} AS s3m, {s4} AS s4m, {s5} AS s5m FROM r),
t2 AS (SELECT *, s1_user <> 'OK' OR uid = 1 AS stop1 FROM t1),
t3 AS (SELECT *, CASE WHEN stop1 THEN NULL ELSE 'OK' END AS s2_groups,
              CASE WHEN stop1 THEN NULL ELSE s3m END AS s3_model_acl FROM t2),
t4 AS (SELECT *, CASE WHEN stop1 OR s3_model_acl <> 'OK' THEN NULL ELSE s4m END AS s4_record_rules FROM t3),
t5 AS (SELECT *, CASE WHEN stop1 OR s3_model_acl <> 'OK' OR s4_record_rules <> 'OK' THEN NULL ELSE s5m END
                   AS s5_domain FROM t4),
t6 AS (SELECT *, CASE WHEN s1_user IN ('DENIED', 'ERROR') THEN 's1_user'
                      WHEN s2_groups IN ('DENIED', 'ERROR') THEN 's2_groups'
                      WHEN s3_model_acl IN ('DENIED', 'ERROR') THEN 's3_model_acl'
                      WHEN s4_record_rules IN ('DENIED', 'ERROR') THEN 's4_record_rules'
                      WHEN s5_domain IN ('DENIED', 'ERROR') THEN 's5_domain' END AS failing_stage FROM t5)
SELECT request_id, uid, model, op, s1_user, s2_groups, s3_model_acl, s4_record_rules, s5_domain, failing_stage,
       CASE WHEN failing_stage IS NULL THEN 'ALLOWED' ELSE 'DENIED' END AS verdict
FROM t6"""


@query("access_trace", _trace_sql(), ops="R4 R5 R6 R7 R8 R9 R10 J15 J20")
def q_access_trace(spark, sf_dir):
    return trace(spark, sf_dir)


# ------------------------------------------- rules from tables, reasons, suggestions
# A part is a record rule of model p_partkey div 8 and a customer an access rule of model
# c_custkey div 6, so rules grow with the data and a model has as many at any scale.
# Some models have no rules of a kind; orders of customers beyond the parts ask for unknown ones.

def _model(number):
    return F.concat(F.lit("m."), number.cast("long").cast("string"))


def table_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    o = requests(spark, sf_dir).withColumn("model", _model(F.floor(F.col("o_custkey") / 5)))
    keep = with_users(o, spark, sf_dir)
    return keep.withColumn("record", F.when(k % 17 != 3, F.col("record")))


# domains by p_partkey % 12; {n} is 1000 * p_size
DOMAINS = (
    "[('o_totalprice', '>', {n})]",
    "['|', ('o_orderstatus', '=', 'O'), ('o_orderstatus', 'in', ['F', 'P'])]",
    "[('o_custkey', '=', user.id)]",
    "['!', ('o_orderstatus', '=', 'F')]",
    "[('o_orderpriority', '=like', '1-%'), ('o_totalprice', '>=', {n})]",
    "[('o_custkey', 'in', company_ids), ('partner_id.name', 'ilike', 'x')]",
    "[]",
    "[('o_orderpriority', 'not ilike', '%low%'), ('o_totalprice', '<', {n})]",
    "[('o_orderstatus', '=',",
    "['&', '|', ('o_custkey', '<=', {n}), ('o_orderstatus', '!=', 'P'), '!', ('o_totalprice', '<', 1000.5)]",
    "[('o_orderkey', 'not in', [user.unknown, 5])]",
    "[('o_orderstatus', 'in', ['O', 'P']), ('o_totalprice', '!=', False)]",
)


def table_rules(spark, sf_dir):
    c, p = F.col("c_custkey"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    models = (parts.select(_model(F.floor(p / 8)).alias("model")).distinct()
              .unionByName(spark.createDataFrame([("res.users",), ("res.groups",)], "model string")))
    group = (F.when(c % 9 == 0, "0").when(c % 9 == 1, "").when(c % 9 == 2, "base")
             .when(c % 2 == 0, (F.col("c_nationkey") + 10).cast("string")).otherwise((c % 5 + 100).cast("string")))
    access = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").filter(F.floor(c / 6) % 10 != 7)
              .select(_model(F.floor(c / 6)).alias("model"), c.cast("int").alias("pos"), group.alias("group_id"), (c % 2 == 0).alias("perm_read"),
                      (c % 3 == 0).alias("perm_write"), (c % 4 != 0).alias("perm_create"), (c % 5 == 0).alias("perm_unlink")))
    size, special = F.col("p_size"), p % 3 == 0
    text = F.replace(F.get(F.array(*[F.lit(d) for d in DOMAINS]), p % 12), F.lit("{n}"), (size * 1000).cast("string"))
    groups = F.when(p % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((size % 25 + 10).cast("int"), (p % 5 + 100).cast("int")))
    record = parts.filter(F.floor(p / 8) % 10 != 3).select(
        _model(F.floor(p / 8)).alias("model"), p.cast("int").alias("pos"), F.col("p_name").alias("name"), groups.alias("group_ids"),
        text.alias("domain"), *[(~special & (size % m == 0)).alias(f"perm_{o}") for o, m in (("read", 2), ("write", 3), ("create", 5), ("unlink", 7))])
    return models, access, record


def _sql_text(text, *values):
    """A fixed text with its %s filled in by SQL expressions."""
    return f"printf('{text.replace(chr(39), chr(39) * 2)}'" + "".join(f", {v}" for v in values) + ")"


def _condition(field, op, expected, passes, actual=None, error=None):
    shown = f"'{error}'" if error else f"'{op} ' || {expected} || ' (actual: ' || {actual or 'r.' + field} || ')'"
    joint = ": " if error else " "
    return f"CASE WHEN {passes} THEN NULL ELSE '{field}{joint}' || {shown} END"


_P, _N = "CAST(r.o_totalprice AS DOUBLE)", "(1000 * p_size)"
_PT = ("CASE WHEN r.o_totalprice = floor(r.o_totalprice) THEN CAST(CAST(r.o_totalprice AS BIGINT) AS VARCHAR) "
       "ELSE CAST(CAST(r.o_totalprice AS DOUBLE) AS VARCHAR) END")
_CK, _NT = "CAST(r.o_custkey AS VARCHAR)", f"CAST({_N} AS VARCHAR)"
# (passes, failed conditions) of each of DOMAINS, written out by hand
_RULE_SQL = (
    (f"{_P} - {_N} >= 1e-9", [_condition("o_totalprice", ">", _NT, f"{_P} - {_N} >= 1e-9", _PT)]),
    ("r.o_orderstatus IN ('O', 'F', 'P')", [_condition("o_orderstatus", "=", "'O'", "r.o_orderstatus = 'O'"),
                                            _condition("o_orderstatus", "in", "'[F P]'", "r.o_orderstatus IN ('F', 'P')")]),
    ("r.o_custkey = r.uid", [_condition("o_custkey", "=", "CAST(r.uid AS VARCHAR)", "r.o_custkey = r.uid", _CK)]),
    ("r.o_orderstatus <> 'F'", [_condition("o_orderstatus", "=", "'F'", "r.o_orderstatus = 'F'")]),
    (f"r.o_orderpriority LIKE '1-%' AND {_P} - {_N} > -1e-9",
     [_condition("o_orderpriority", "=like", "'1-%'", "r.o_orderpriority LIKE '1-%'"),
      _condition("o_totalprice", ">=", _NT, f"{_P} - {_N} > -1e-9", _PT)]),
    ("false", [_condition("o_custkey", "in", "'[' || array_to_string(r.company_ids, ' ') || ']'", "list_contains(r.company_ids, r.o_custkey)", _CK),
               _condition("partner_id.name", "", "''", "false", error='field "partner_id.name" not found in record data')]),
    ("true", []),
    (f"NOT r.o_orderpriority ILIKE '%low%' AND {_P} - {_N} <= -1e-9",
     [_condition("o_orderpriority", "not ilike", "'%low%'", "NOT r.o_orderpriority ILIKE '%low%'"),
      _condition("o_totalprice", "<", _NT, f"{_P} - {_N} <= -1e-9", _PT)]),
    ("false", None),
    (f"(r.o_custkey <= {_N} OR r.o_orderstatus <> 'P') AND NOT {_P} - 1000.5 <= -1e-9",
     [_condition("o_custkey", "<=", _NT, f"r.o_custkey <= {_N}", _CK), _condition("o_orderstatus", "!=", "'P'", "r.o_orderstatus <> 'P'"),
      _condition("o_totalprice", "<", "'1000.5'", f"{_P} - 1000.5 <= -1e-9", _PT)]),
    ("false", [_condition("o_orderkey", "", "''", "false", error=ar.UNRESOLVED.replace("%s", "user.unknown"))]),
    ("r.o_orderstatus IN ('O', 'P') AND r.o_totalprice <> 0",
     [_condition("o_orderstatus", "in", "'[O P]'", "r.o_orderstatus IN ('O', 'P')"),
      _condition("o_totalprice", "!=", "'false'", "r.o_totalprice <> 0", _PT)]),
)


def _table_sql():
    t = _sql_text
    domain = "CASE p_partkey % 12 " + " ".join(
        f"WHEN {i} THEN replace('{d.replace(chr(39), chr(39) * 2)}', '{{n}}', CAST(p_size * 1000 AS VARCHAR))" for i, d in enumerate(DOMAINS)) + " END"
    passes = "CASE kind " + " ".join(f"WHEN {i} THEN {p}" for i, (p, _) in enumerate(_RULE_SQL)) + " END"
    failed = "CASE kind " + " ".join(
        f"WHEN {i} THEN " + (f"'parse error: {ar.BAD_DOMAIN}'" if c is None else
                             f"coalesce(nullif(concat_ws('; ', {', '.join(c)}), ''), 'unknown')" if c else "'unknown'")
        for i, (_, c) in enumerate(_RULE_SQL)) + " END"
    r, mq = ar.REASONS, "('\"' || model || '\"')"
    texts = {k: (v[0], v[1], v[2], v[3]) for k, v in ar.TEXTS.items()}

    def suggestion(key, pos, cond, summary=(), detail=(), stage=None):
        where, severity, head, body = texts[key]
        return (f"SELECT request_id, {pos} AS pos, {stage or chr(39) + where + chr(39)} AS stage, '{severity}' AS severity, "
                f"{t(head, *summary)} AS summary, {t(body, *detail)} AS detail FROM last WHERE {cond}")

    return "WITH RECURSIVE " + _EDGES_SQL + f""",
rq AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderkey % 50 = 7 THEN o_custkey + 100000000 WHEN o_orderkey % 3 = 0 THEN o_custkey
              ELSE o_custkey % 100 + 1 END AS uid,
         'm.' || CAST(o_custkey // 5 AS VARCHAR) AS model,
         CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'create' ELSE 'unlink' END AS op,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey % 17 <> 3 AS has_record
  FROM orders),
r AS (SELECT rq.*, c_name AS login, ue.active, ue.company_ids, coalesce(ue.effective, []) AS effective, len(ue.group_ids) AS n_direct,
             ue.uid IS NOT NULL AS user_found
      FROM rq LEFT JOIN ue USING (uid) LEFT JOIN customer ON c_custkey = rq.uid),
models AS (SELECT DISTINCT 'm.' || CAST(p_partkey // 8 AS VARCHAR) AS model FROM part),
acc AS (
  SELECT 'm.' || CAST(c_custkey // 6 AS VARCHAR) AS model, c_custkey AS pos,
         CASE c_custkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN 'base'
              ELSE CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + 10 AS VARCHAR) ELSE CAST(c_custkey % 5 + 100 AS VARCHAR) END END AS gid,
         CASE o WHEN 'read' THEN c_custkey % 2 = 0 WHEN 'write' THEN c_custkey % 3 = 0 WHEN 'create' THEN c_custkey % 4 <> 0
                ELSE c_custkey % 5 = 0 END AS perm, o AS op
  FROM customer, (SELECT unnest(['read', 'write', 'create', 'unlink']) AS o) WHERE c_custkey // 6 % 10 <> 7),
accs AS (SELECT model, op, count(*) AS n_access, string_agg(gid, ', ' ORDER BY pos) AS access_groups FROM acc GROUP BY 1, 2),
ra AS (
  SELECT request_id, count(*) FILTER (WHERE gid IN ('', '0') OR list_contains(effective, TRY_CAST(gid AS INTEGER))) AS n_applicable,
         count(*) FILTER (WHERE perm AND (gid IN ('', '0') OR list_contains(effective, TRY_CAST(gid AS INTEGER)))) AS n_granting
  FROM r JOIN acc USING (model, op) GROUP BY 1),
rules AS (
  SELECT 'm.' || CAST(p_partkey // 8 AS VARCHAR) AS model, p_partkey AS pos, p_name AS name, p_partkey % 12 AS kind, p_size,
         {domain} AS domain, p_partkey % 4 = 0 AS is_global,
         CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_size % 25 + 10, p_partkey % 5 + 100] END AS gids, o AS op
  FROM part, (SELECT unnest(['read', 'write', 'create', 'unlink']) AS o)
  WHERE p_partkey // 8 % 10 <> 3
    AND (p_partkey % 3 = 0 OR NOT (p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0)
         OR p_size % (CASE o WHEN 'read' THEN 2 WHEN 'write' THEN 3 WHEN 'create' THEN 5 ELSE 7 END) = 0)),
listed AS (
  SELECT model, op, count(*) FILTER (WHERE is_global) AS n_global, count(*) FILTER (WHERE NOT is_global) AS n_group,
         string_agg(name, ', ' ORDER BY pos) FILTER (WHERE NOT is_global) AS names,
         flatten(list(gids ORDER BY pos) FILTER (WHERE NOT is_global)) AS gids FROM rules GROUP BY 1, 2),
ev AS (
  SELECT r.request_id, rules.*, is_global OR len(list_intersect(gids, r.effective)) > 0 AS applies,
         {passes} AS holds, {failed} AS fails
  FROM r JOIN rules USING (model, op)),
ev2 AS (SELECT * EXCLUDE (holds, fails), applies AND holds AS pass,
               CASE WHEN applies THEN fails ELSE ': {ar.NOT_APPLICABLE.replace("'", "''")}' END AS failed FROM ev),
re AS (
  SELECT request_id, count(*) FILTER (WHERE NOT is_global AND applies) AS n_applied, count(*) FILTER (WHERE is_global AND NOT pass) AS global_failed,
         coalesce(bool_or(pass) FILTER (WHERE NOT is_global), false) OR count(*) FILTER (WHERE NOT is_global AND applies) = 0 AS group_pass,
         string_agg(name || ' (domain: ' || domain || ', failed: ' || failed || ')', chr(10) || '  - ' ORDER BY pos)
           FILTER (WHERE NOT is_global AND NOT pass) AS lines
  FROM ev2 GROUP BY 1),
f AS (
  SELECT r.*, models.model IS NOT NULL AS in_schema, coalesce(n_access, 0) AS n_access, access_groups, coalesce(n_applicable, 0) AS n_applicable,
         coalesce(n_granting, 0) AS n_granting, coalesce(n_global, 0) AS n_global, coalesce(n_group, 0) AS n_group, names, gids,
         coalesce(n_applied, 0) AS n_applied, global_failed, group_pass, lines,
         r.model IN (SELECT model FROM rules) AS has_rules
  FROM r LEFT JOIN models USING (model) LEFT JOIN accs USING (model, op) LEFT JOIN ra USING (request_id)
  LEFT JOIN listed USING (model, op) LEFT JOIN re USING (request_id)),
g1 AS (SELECT *,
  CASE WHEN NOT user_found THEN 'DENIED' WHEN NOT active THEN 'DENIED' ELSE 'OK' END AS v1,
  CASE WHEN NOT user_found THEN {t(r['no user'])} WHEN NOT active THEN {t(r['inactive'], 'CAST(uid AS VARCHAR)', 'login')}
       WHEN uid = 1 THEN {t(r['superuser'], 'CAST(uid AS VARCHAR)', 'login')}
       ELSE {t(r['user'], 'CAST(uid AS VARCHAR)', 'login', 'CAST(n_direct AS VARCHAR)')} END AS r1,
  {t(r['groups'], 'CAST(uid AS VARCHAR)', 'login', 'CAST(n_direct AS VARCHAR)', 'CAST(len(effective) - n_direct AS VARCHAR)',
     'CAST(len(effective) AS VARCHAR)')} AS r2,
  CASE WHEN NOT in_schema THEN 'ERROR' WHEN n_access > 0 AND n_granting > 0 THEN 'OK' ELSE 'DENIED' END AS v3,
  CASE WHEN NOT in_schema THEN {t(r['no model'], mq)} WHEN n_access = 0 THEN {t(r['no access'], mq)}
       WHEN n_granting > 0 THEN {t(r['granted'], mq, 'op', 'CAST(n_granting AS VARCHAR)', 'CAST(n_access AS VARCHAR)')}
       WHEN n_applicable = 0 THEN {t(r['no member'], mq, 'op', 'CAST(n_access AS VARCHAR)')}
       ELSE {t(r['no grant'], mq, 'op', 'CAST(n_applicable AS VARCHAR)', 'op')} END AS r3,
  CASE WHEN n_global + n_group = 0 THEN 'SKIPPED' WHEN n_group > 0 AND n_applied = 0 THEN 'DENIED' ELSE 'OK' END AS v4,
  CASE WHEN NOT has_rules THEN {t(r['no rules'], mq)} WHEN n_global + n_group = 0 THEN {t(r['no rules for op'], mq, 'op')}
       WHEN n_group > 0 AND n_applied = 0 THEN {t(r['no rule group'], mq, 'op', 'CAST(n_group AS VARCHAR)')}
       ELSE {t(r['rules'], mq, 'op', 'CAST(n_global + n_applied AS VARCHAR)', 'CAST(n_global AS VARCHAR)', 'CAST(n_applied AS VARCHAR)')} END AS r4,
  CASE WHEN NOT has_record THEN 'SKIPPED' WHEN global_failed = 0 AND group_pass THEN 'OK' ELSE 'DENIED' END AS v5,
  CASE WHEN NOT has_record THEN {t(r['no record'])} WHEN global_failed = 0 AND group_pass THEN {t(r['domain'], mq, 'op')}
       ELSE {t(r['domain failed'], mq, 'op', "concat_ws('; ', CASE WHEN global_failed > 0 THEN CAST(global_failed AS VARCHAR) || ' global rule(s) failed' END, CASE WHEN NOT group_pass THEN 'no group rule domain passed' END)")} END AS r5
  FROM f),
g2 AS (SELECT *, v1 = 'OK' AND uid <> 1 AS go2 FROM g1),
g3 AS (SELECT *, go2 AND v3 = 'OK' AS go4 FROM g2),
g AS (SELECT *, go4 AND v4 = 'OK' AS go5 FROM g3),
stages AS (
  SELECT request_id, 1 AS pos, 'user' AS stage, v1 AS verdict, r1 AS reason FROM g
  UNION ALL SELECT request_id, 2, 'groups', 'OK', r2 FROM g WHERE go2
  UNION ALL SELECT request_id, 3, 'model_acl', v3, r3 FROM g WHERE go2
  UNION ALL SELECT request_id, 4, 'record_rule', v4, r4 FROM g WHERE go4
  UNION ALL SELECT request_id, 5, 'domain', v5, r5 FROM g WHERE go5),
last AS (
  SELECT g.*, s.pos AS step, s.stage AS failing, s.verdict AS bad, s.reason AS why
  FROM g JOIN stages s ON s.request_id = g.request_id AND s.verdict IN ('DENIED', 'ERROR')),
suggested AS (
  {suggestion("error", 1, "bad = 'ERROR'", ("failing",), ("failing", "why"), "failing")}
  UNION ALL {suggestion("inactive", 1, "step = 1 AND user_found")}
  UNION ALL {suggestion("not found", 1, "step = 1 AND NOT user_found")}
  UNION ALL {suggestion("no rules", 1, "step = 3 AND bad = 'DENIED' AND n_access = 0", (mq,),
                        (mq, "replace(model, '.', '_')", "model", "replace(model, '.', '_')"))}
  UNION ALL {suggestion("no grant", 1, "step = 3 AND bad = 'DENIED' AND n_access > 0 AND n_applicable > 0", ("op",),
                        ("CAST(n_applicable AS VARCHAR)", mq, "op", "op"))}
  UNION ALL {suggestion("no member", 1, "step = 3 AND bad = 'DENIED' AND n_access > 0 AND n_applicable = 0", ("op", mq),
                        ("CAST(n_access AS VARCHAR)", mq, "access_groups"))}
  UNION ALL {suggestion("no rule group", 1, "step = 4 AND bad = 'DENIED'", (mq,), ("CAST(n_group AS VARCHAR)", "names",
                        "array_to_string([x for x, i in gids if list_position(gids, x) = i], ', ')"))}
  UNION ALL SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY e.pos), 'domain', 'high', {t(texts["global rule"][2], "'\"' || name || '\"'")},
    {t(texts["global rule"][3], "'\"' || name || '\"'", "domain", "failed")}
    FROM last JOIN ev2 e USING (request_id) WHERE step = 5 AND e.is_global AND NOT e.pass
  UNION ALL {suggestion("group rules", "global_failed + 1", "step = 5 AND NOT group_pass", (), ("lines",))})"""


@query("access_stages", _table_sql() + """
SELECT request_id, pos, stage, verdict, reason FROM stages""", ops="R4 R5 R6 R7 R8 R9 R10 J15")
def q_access_stages(spark, sf_dir):
    t = ar.trace(table_requests(spark, sf_dir), *table_rules(spark, sf_dir))
    return (t.select("request_id", F.posexplode("stages").alias("pos", "s"))
            .select("request_id", (F.col("pos") + 1).alias("pos"), "s.stage", "s.verdict", "s.reason"))


@query("access_suggestions", _table_sql() + """
SELECT request_id, CAST(pos AS INTEGER) AS pos, stage, severity, summary, detail FROM suggested""", ops="R11 R8 N3")
def q_access_suggestions(spark, sf_dir):
    t = ar.suggestions(ar.trace(table_requests(spark, sf_dir), *table_rules(spark, sf_dir)))
    return (t.select("request_id", F.posexplode("suggestions").alias("pos", "s"))
            .select("request_id", (F.col("pos") + 1).alias("pos"), "s.stage", "s.severity", "s.summary", "s.detail"))
