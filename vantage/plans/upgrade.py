"""Upgrade-scan queries over the full 14.0 -> 19.0 path.

Schema snapshots are derived from ``part``: environment ``env<partkey % 3>``,
model = the catalog's k-th model target (k = partkey mod #models), field =
the catalog's j-th field target (j = partkey mod #fields) and the first word
of the part name.  Source files are ``documents`` (as .py) and ``pages`` (as
.xml).  The catalog lists are fixed values built from the rule file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import upgrade as up
from vantage.plans.errors import WS_SQL
from vantage.plans.registry import query
from vantage.sources.tables import table

FROM_V, TO_V = "14.0", "19.0"
_RULES = up.load_rules()
MODEL_TARGETS = sorted({t for r in _RULES for t in [
    (r["old_name"] or r["model"]) if r["kind"] in ("model_removed", "model_renamed") else
    r["model"] if r["kind"] in ("field_removed", "field_renamed", "field_type_changed") else ""] if t})
FIELD_TARGETS = sorted({t for r in _RULES for t in (r["field"], r["old_name"])
                        if t and r["kind"] in ("field_removed", "field_renamed", "field_type_changed")})


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def schema_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    m = F.element_at(F.array(*[F.lit(x) for x in MODEL_TARGETS]), (F.col("p_partkey") % len(MODEL_TARGETS) + 1).cast("int"))
    f = F.element_at(F.array(*[F.lit(x) for x in FIELD_TARGETS]), (F.col("p_partkey") % len(FIELD_TARGETS) + 1).cast("int"))
    w = F.get(F.split(F.col("p_name"), " "), 0)
    return p.select(F.concat(F.lit("env"), (F.col("p_partkey") % 3).cast("string")).alias("env_id"),
                    F.lower(m).alias("model"), F.explode(F.array(F.lower(f), F.lower(w))).alias("field"))


def issues(spark, sf_dir):
    rules = up.rules_on_path(up.rules_df(spark), FROM_V, TO_V)
    return up.schema_scan(rules, schema_index(spark, sf_dir))


def _rules_values_sql() -> str:
    rows = ",\n".join("(" + ", ".join([str(r["ord"])] + [_sq(r[c]) for c in up.RULE_COLUMNS[1:]]) + ")"
                      for r in _RULES)
    return "rules(" + ", ".join(up.RULE_COLUMNS) + ") AS (VALUES\n" + rows + ")"


_IDX_SQL = f"""
idx AS (
  SELECT 'env' || CAST(p_partkey % 3 AS VARCHAR) AS env_id,
         lower([{', '.join(_sq(x) for x in MODEL_TARGETS)}][p_partkey % {len(MODEL_TARGETS)} + 1]) AS model,
         unnest([lower([{', '.join(_sq(x) for x in FIELD_TARGETS)}][p_partkey % {len(FIELD_TARGETS)} + 1]),
                 lower(string_split(p_name, ' ')[1])]) AS field
  FROM part)"""

_SCHEMA_SQL = "WITH " + _rules_values_sql() + "," + _IDX_SQL + """,
ms AS (SELECT DISTINCT env_id, model FROM idx),
fs AS (SELECT DISTINCT env_id, model, field FROM idx WHERE field IS NOT NULL),
iss AS (
  SELECT ms.env_id, r.* FROM ms JOIN rules r
    ON r.kind IN ('model_removed', 'model_renamed') AND ms.model = coalesce(nullif(r.old_name, ''), r.model)
  UNION ALL
  SELECT fs.env_id, r.* FROM fs JOIN rules r
    ON r.kind IN ('field_removed', 'field_renamed', 'field_type_changed') AND fs.model = r.model
   AND fs.field = CASE r.kind WHEN 'field_removed' THEN r.field
                              WHEN 'field_renamed' THEN coalesce(nullif(r.field, ''), r.old_name)
                              ELSE coalesce(nullif(r.old_name, ''), r.field) END
  UNION ALL
  SELECT e.env_id, r.* FROM (SELECT DISTINCT env_id FROM ms) e JOIN rules r
    ON r.kind IN ('method_deprecated', 'xmlid_changed'))"""


@query("schema_scan", _SCHEMA_SQL + "\nSELECT * FROM iss", ops="R12 J9 R15 X5")
def q_schema_scan(spark, sf_dir):
    return issues(spark, sf_dir)


@query("schema_scan_summary", _SCHEMA_SQL + """
SELECT env_id, count(*) FILTER (WHERE severity = 'breaking') AS breaking_count,
       count(*) FILTER (WHERE severity = 'warning') AS warning_count,
       count(*) FILTER (WHERE severity = 'minor') AS minor_count
FROM iss GROUP BY 1""", ops="A25")
def q_schema_scan_summary(spark, sf_dir):
    return up.severity_counts(issues(spark, sf_dir), ["env_id"])


# --------------------------------------------------------------- code scan

def source_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"))
    p = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"),
        F.col("html").alias("content"))
    return d.unionByName(p)


PATTERNS = up.expand_patterns([r for r in _RULES])


def findings(spark, sf_dir):
    rules = up.rules_on_path(up.rules_df(spark), FROM_V, TO_V)
    return up.scan_files(source_files(spark, sf_dir), rules, PATTERNS)


def _code_sql() -> str:
    def arm(lang, src):
        pats = [p for p in PATTERNS if p.lang == lang]
        cases = ", ".join(f"CASE WHEN regexp_matches(line, {_sq(p.regex)}) THEN {p.ord} END" for p in pats)
        ext = ".xml" if lang == "xml" else ".py"
        cond = f"ext = '{ext}'" + ("" if lang == "py_content" else " AND NOT is_comment")
        return (f"SELECT path, line_no, line, unnest(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL)))"
                f" AS ord, {src} AS src FROM lines WHERE {cond}")
    arms = [arm(lang, src) for lang, src in (("py", 0), ("xml", 0), ("py_content", 1))
            if any(p.lang == lang for p in PATTERNS)]
    trim = f"regexp_replace(line, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"
    return "WITH " + _rules_values_sql() + f""",
files AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.py' AS path, '.py' AS ext, text AS content FROM documents
          UNION ALL
          SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.xml', '.xml', html FROM pages),
lines0 AS (SELECT path, ext, unnest(string_split(content, chr(10))) AS line,
                  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM files),
lines AS (SELECT *, starts_with({trim}, '#') OR starts_with({trim}, '<!--')
                    OR starts_with({trim}, '//') AS is_comment FROM lines0),
hits AS ({' UNION ALL '.join(arms)}),
j AS (SELECT h.path, h.line_no, h.line, h.src, r.* FROM hits h JOIN rules r USING (ord)),
k AS (SELECT *, row_number() OVER (PARTITION BY path, line_no, old_name, field, model ORDER BY src, ord) AS rn FROM j)
SELECT path, line_no, ord, kind, severity, model, field, old_name, new_name, from_version, to_version,
       CASE WHEN length({trim}) > 200 THEN substr({trim}, 1, 200) || '…' ELSE {trim} END AS snippet
FROM k WHERE rn = 1"""


@query("code_scan", _code_sql(), ops="R13 R14 J10 W13 X3 C26 C18")
def q_code_scan(spark, sf_dir):
    return findings(spark, sf_dir)


# ------------------------------------------------- code scan of written sources

#: What a part writes into its source file, and the findings expected of it, by hand: (line in it, rule).
SNIPPETS = (
    ("uid = self._uid", ((0, "record._uid"),)),
    ("ctx = self.env.context", ()),
    ("ctx = dict(self._context)", ((0, "record._context"),)),
    ("rows = model.read_group(\n    domain, columns,\n    # whole\n    lazy=False)",
     ((0, "BaseModel.read_group (lazy=False)"),)),
    ("from odoo.osv import expression", ((0, "odoo.osv.expression"),)),
    ("dom = expression.AND([a, b])", ((0, "odoo.osv.expression"),)),
    ("class Warning(Exception):\n    pass", ()),
    ("if bad:\n    raise Warning(msg)", ((1, "raise Warning"),)),
    ("    _columns = {", ((0, "_columns"),)),
    ("wide = table_columns + other._columns", ()),
    ("n = model.search(dom, count=True)", ((0, "BaseModel.search (count=True)"),)),
    ("# raise Warning(msg)", ()),
    ("a = model.read_group(d); b = model.read_group(d, lazy = False); c = m.read_group(e, lazy=False)",
     ((0, "BaseModel.read_group (lazy=False)"),)),
    ("label = ustr(value)\npool = self.pool.get(label)", ((0, "ustr"), (1, "self.pool"))),
)
PARTS_PER_FILE = 20


def written_sources(spark, sf_dir):
    """A .py file for every twenty parts: each part's snippet by its number, in order."""
    texts = F.array(*[F.lit(t) for t, _ in SNIPPETS])
    p = table(spark, sf_dir, "part").select("p_partkey")
    file = F.floor(F.col("p_partkey") / PARTS_PER_FILE).cast("long")
    snippet = F.get(texts, (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    return (p.groupBy(file.alias("f")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", snippet.alias("t")))).alias("s"))
            .select(F.concat(F.lit("addons/f"), F.col("f").cast("string"), F.lit(".py")).alias("path"),
                    F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("content")))


_SNIPPET_VALUES = ", ".join(f"({i}, {_sq(t)})" for i, (t, _) in enumerate(SNIPPETS))
_EXPECTED_VALUES = ", ".join(f"({i}, {at}, {_sq(rule)})" for i, (_, found) in enumerate(SNIPPETS) for at, rule in found)


@query("code_scan_sources", "WITH " + _rules_values_sql() + f""",
snip(t, txt) AS (VALUES {_SNIPPET_VALUES}),
want(t, line_at, old_name) AS (VALUES {_EXPECTED_VALUES}),
placed AS (SELECT p_partkey // {PARTS_PER_FILE} AS f, t, txt,
                  coalesce(sum(len(string_split(txt, chr(10)))) OVER (PARTITION BY p_partkey // {PARTS_PER_FILE}
                    ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lines_before
           FROM part JOIN snip ON t = p_partkey % {len(SNIPPETS)})
SELECT 'addons/f' || CAST(f AS VARCHAR) || '.py' AS path, CAST(lines_before + line_at + 1 AS BIGINT) AS line_no,
       r.ord, r.kind, r.severity, r.model, r.field, r.old_name, r.new_name, r.from_version, r.to_version,
       trim(string_split(txt, chr(10))[line_at + 1]) AS snippet
FROM placed JOIN want USING (t) JOIN rules r USING (old_name) WHERE r.kind = 'method_deprecated'""",
       ops="R13 R14 J10 W13 C26")
def q_code_scan_sources(spark, sf_dir):
    rules = up.rules_on_path(up.rules_df(spark), FROM_V, TO_V)
    return up.scan_files(written_sources(spark, sf_dir), rules, PATTERNS)
