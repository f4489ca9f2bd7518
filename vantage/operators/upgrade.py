"""Upgrade-risk scans.

* The rule catalog (R15) is a fixed data file of 110 rules, read as a small
  DataFrame (its size is bounded by the file, so it may be broadcast).
* Patterns (R14) are expanded once on the driver from the catalog.
* The schema scan (J9) joins rules with the exploded schema index per kind.
* The code scan (J10) is a projection over text lines: a substring test on
  the rules' target names pre-filters lines, then an array of literal
  ``rlike`` tests yields the rule ordinals that fire; no nested-loop join.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.functions.errors import ltrim_ws, trim_ws

RULES_FILE = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "deprecation_rules.json")
# The supported version order.
VERSION_ORDER = ("14.0", "15.0", "16.0", "17.0", "18.0", "19.0")
MULTI_LINE_RULE = "BaseModel.read_group (lazy=False)"
RULE_COLUMNS = ("ord", "from_version", "to_version", "kind", "severity", "model", "field", "old_name",
                "new_name", "message", "fix")


def load_rules() -> list[dict]:
    with open(RULES_FILE, encoding="utf-8") as f:
        return json.load(f)


def rules_df(spark: SparkSession) -> DataFrame:
    schema = ("ord int, from_version string, to_version string, kind string, severity string, model string, "
              "field string, old_name string, new_name string, message string, fix string")
    return spark.createDataFrame([tuple(r[c] for c in RULE_COLUMNS) for r in load_rules()], schema)


def path_range(from_version: str, to_version: str) -> tuple[int, int]:
    """Ordinal range of transitions on the path; unsupported -> error."""
    if from_version not in VERSION_ORDER or to_version not in VERSION_ORDER:
        raise ValueError(f"unsupported version path: {from_version} → {to_version}")
    a, b = VERSION_ORDER.index(from_version), VERSION_ORDER.index(to_version)
    if a >= b:
        raise ValueError(f"unsupported version path: {from_version} → {to_version}")
    return a, b


def rules_on_path(rules: DataFrame, from_version: str, to_version: str) -> DataFrame:
    """Rules of consecutive transitions from ``from_version`` to
    ``to_version`` (a filter on the transition's position)."""
    a, b = path_range(from_version, to_version)
    pos = F.array_position(F.array(*[F.lit(v) for v in VERSION_ORDER]), F.col("from_version")) - 1
    return rules.filter((pos >= a) & (pos < b) & (F.array_position(
        F.array(*[F.lit(v) for v in VERSION_ORDER]), F.col("to_version")) - 1 == pos + 1))


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rule count per transition."""
    return rules.groupBy("from_version", "to_version").agg(F.count(F.lit(1)).alias("rule_count"))


# ------------------------------------------------------------- schema scan

def schema_scan(rules: DataFrame, index: DataFrame, env_col: str = "env_id") -> DataFrame:
    """Issues per environment.  ``index``: (env, model, field) with
    model and field lower-cased; a model without fields has field NULL.

    model_removed / renamed fire when coalesce(old_name, model) exists;
    field_removed when (model, field) exists; field_renamed on
    coalesce(field, old_name); field_type_changed on coalesce(old_name, field);
    method / xmlid rules always fire; other kinds never."""
    nz = lambda c: F.when(F.col(c) != "", F.col(c))
    models = index.select(env_col, "model").distinct()
    fields = index.filter(F.col("field").isNotNull()).select(env_col, "model", "field").distinct()
    r = F.broadcast(rules)
    m_rules = r.filter(F.col("kind").isin("model_removed", "model_renamed")) \
        .withColumn("_target", F.coalesce(nz("old_name"), F.col("model")))
    by_model = models.join(m_rules, models.model == m_rules._target).select(env_col, *[m_rules[c] for c in RULE_COLUMNS])
    f_target = (F.when(F.col("kind") == "field_removed", F.col("field"))
                .when(F.col("kind") == "field_renamed", F.coalesce(nz("field"), F.col("old_name")))
                .when(F.col("kind") == "field_type_changed", F.coalesce(nz("old_name"), F.col("field"))))
    f_rules = r.filter(F.col("kind").isin("field_removed", "field_renamed", "field_type_changed")) \
        .withColumn("_f", f_target)
    by_field = (fields.join(f_rules, (fields.model == f_rules.model) & (fields.field == f_rules._f))
                .select(env_col, *[f_rules[c] for c in RULE_COLUMNS]))
    always = [row for row in load_rules() if row["kind"] in ("method_deprecated", "xmlid_changed")]
    always_ords = [r_["ord"] for r_ in always]
    envs = models.select(env_col).distinct()
    fired = envs.select(env_col, F.explode(F.array(*[F.lit(o) for o in always_ords])).alias("ord"))
    by_always = fired.join(r.filter(F.col("ord").isin(always_ords)), "ord").select(env_col, *RULE_COLUMNS)
    return by_model.unionByName(by_field).unionByName(by_always)


def severity_counts(issues: DataFrame, keys) -> DataFrame:
    """Counts of breaking / warning / minor per key."""
    return issues.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "breaking").alias("breaking_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("severity") == "minor").alias("minor_count"))


# -------------------------------------------------------- pattern expansion

@dataclass(frozen=True)
class Pattern:
    ord: int
    lang: str       # 'py' | 'py_content' | 'xml'
    regex: str      # written with \b (RE2 flavour)
    literal: str = ""  # a substring every match contains (for the pre-filter)


_META = set("\\.+*?()|[]{}^$")


def _q(s: str) -> str:
    """Escape regex metacharacters only (valid in both Java and RE2)."""
    return "".join("\\" + c if c in _META else c for c in s)


def _last_word(old: str, seps: str) -> str:
    parts = [p for p in re.split("[" + re.escape(seps) + "]", old) if p]
    return parts[-1] if parts else ""


# What each deprecated method looks like in Python code.  Alternatives are written out, and
# patterns that another one of their rule covers are left out.  A rule that is not listed looks for
# its name's last word.  The rule of env.ref has a pattern that never compiles, so it never fires.
METHOD_PATTERNS = {
    "record._uid": [r"\bself\._uid\b"],
    "record._context": [r"\bself\._context\b"],
    "record._cr": [r"\bself\._cr\b"],
    "_apply_ir_rules": [r"\._apply_ir_rules\s*\("],
    "_flush_search": [r"def _flush_search\s*\("],
    "_company_default_get": [r"\._company_default_get\s*\("],
    "name_get": [r"def name_get\s*\(\s*self\s*\)"],
    "get_xml_id": [r"\.get_xml_id\s*\(\s*\)"],
    "fields_get_keys": [r"\.fields_get_keys\s*\(\s*\)"],
    "get_module_resource": [r"from\s+odoo\.modules\.module\s+import\s+[^\n]*\bget_module_resource\b",
                            r"\bget_module_resource\s*\("],
    "BaseModel._rec_name_search": [r"\b_rec_name_search\b"],
    "ir.actions.act_window.read_action": [r"\.read_action\s*\("],
    "odoo.osv.expression": [r"\bodoo\.osv\b", r"\bexpression\.AND\b", r"\bexpression\.OR\b",
                            r"\bexpression\.FALSE_DOMAIN\b", r"\bexpression\.TRUE_DOMAIN\b",
                            r"\bexpression\.normalize_domain\b"],
    MULTI_LINE_RULE: [r"\.read_group\s*\([\s\S]*?lazy\s*=\s*False"],
    "BaseModel.search (count=True)": [r"\.search\s*\([^\n]*count\s*=\s*True"],
    "BaseModel.read_group (fill_temporal)": [r"\bfill_temporal\b"],
    "AbstractModel._inherits_check": [r"\b_inherits_check\b"],
    "report.AbstractReportDownloadMixin": [r"\bAbstractReportDownloadMixin\b"],
    "Environment.ref (raise_if_not_found=True default)": [],
    "tools.pycompat": [r"from\s+odoo\.tools\s+import\s+pycompat", r"odoo\.tools\.pycompat"],
    "openerp": [r"\bimport\s+openerp\b", r"\bfrom\s+openerp\b", r"\bopenerp\s*\."],
    "_defaults": [r"^\s*_defaults\s*=\s*\{"],
    "_columns": [r"^\s*_columns\s*=\s*\{"],
    "odoo.exceptions.Warning": [r"from\s+odoo\.exceptions\s+import\s+[^\n]*\bWarning\b"],
    "raise Warning": [r"raise\s+Warning\s*\("],
    "cr_uid_context_signature": [r"def\s+\w+\s*\(\s*self\s*,\s*cr\s*,\s*uid\b"],
    "sudo_with_user_arg": [r"\.sudo\(\s*self\.env\.user\s*\)", r"\.sudo\(\s*self\._uid\s*\)",
                           r"\.sudo\(\s*uid\s*\)", r"\.sudo\(\s*user\s*\)"],
    "self.pool": [r"self\.pool\.get\(", r"self\.pool\["],
    "ustr": [r"from\s+odoo\.tools\.misc\s+import\s+[^\n]*\bustr\b", r"\bustr\s*\("],
}


def python_patterns(rule: dict) -> list[str]:
    """R14 (Python side), by rule kind."""
    k, old, model, field = rule["kind"], rule["old_name"], rule["model"], rule["field"]
    if k == "api_decorator":
        return [r"@" + _q(old) + r"\b"] if old else []
    if k in ("model_removed", "model_renamed"):
        t = old or model
        if not t:
            return []
        e = _q(t)
        return [r"\.env\[['\"]" + e + r"['\"]\]",
                r"_inherit\s*=\s*(?:['\"]" + e + r"['\"]|\[.*?['\"]" + e + r"['\"].*?\])",
                r"_name\s*=\s*['\"]" + e + r"['\"]",
                r"comodel_name\s*=\s*['\"]" + e + r"['\"]"]
    if k in ("field_removed", "field_renamed"):
        t = old or field
        if not t:
            return []
        e = _q(t)
        return [r"\(['\"]" + e + r"['\"]", r"\." + e + r"\b", r"['\"]" + e + r"['\"]"]
    if k == "field_type_changed":
        t = field or old
        if not t:
            return []
        e = _q(t)
        return [r"\." + e + r"\b", r"['\"]" + e + r"['\"]"]
    if k == "method_deprecated":
        if old in METHOD_PATTERNS:
            return METHOD_PATTERNS[old]
        w = _last_word(old, " ().")
        return [r"\b" + _q(w) + r"\b"] if w else []
    if k == "xmlid_changed":
        if not old:
            return []
        e = _q(old)
        return [r"env\.ref\(['\"]" + e + r"['\"]\)", r"ref\(['\"]" + e + r"['\"]\)"]
    return []


def xml_patterns(rule: dict) -> list[str]:
    """R14 (XML side), by rule kind."""
    k, old, model, field = rule["kind"], rule["old_name"], rule["model"], rule["field"]
    if k == "xml_pattern":
        return [_q(old)] if old else []
    if k in ("model_removed", "model_renamed"):
        t = old or model
        if not t:
            return []
        e = _q(t)
        return [r"(?:res_)?model\s*=\s*[\"']" + e + r"[\"']",
                r"src_model\s*=\s*[\"']" + e + r"[\"']",
                r"<field\b[^>]*\bname\s*=\s*[\"']model[\"'][^>]*>" + e + r"</field>",
                r"<field\b[^>]*\bname\s*=\s*[\"']res_model[\"'][^>]*>" + e + r"</field>",
                r"\(['\"]" + e + r"['\"]"]
    if k in ("field_removed", "field_renamed"):
        t = old or field
        if not t:
            return []
        e = _q(t)
        return [r"<field\b[^>]*\bname\s*=\s*[\"']" + e + r"[\"']", r"['\"]" + e + r"['\"]"]
    if k == "field_type_changed":
        t = field or old
        return [r"<field\b[^>]*\bname\s*=\s*[\"']" + _q(t) + r"[\"']"] if t else []
    if k == "method_deprecated":
        if "odoo.osv" in old:
            return [r"\bodoo\.osv\b"]
        w = _last_word(old, " ()")
        if not w or w in ("default", "True", "False"):
            return []
        return [_q(w)]
    if k == "xmlid_changed":
        if not old:
            return []
        e = _q(old)
        return [r"ref\s*=\s*[\"']" + e + r"[\"']", r"<field\b[^>]*\bref\s*=\s*[\"']" + e + r"[\"']",
                r"groups\s*=\s*[\"'][^\"']*" + e + r"[^\"']*[\"']"]
    return []


def _literal(p: str) -> str:
    """Longest run of plain characters in a generated pattern (escapes
    resolved); every match of the pattern contains it."""
    runs, cur, i = [], "", 0
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            n = p[i + 1]
            if n.isalnum():          # class escape such as \b, \s, \d
                runs.append(cur)
                cur = ""
            else:
                cur += n
            i += 2
            continue
        if c in "[](){}|?*+^$.":
            runs.append(cur)
            cur = ""
            if c == "[":             # skip a character class
                j = p.find("]", i + 1)
                i = (j if j > 0 else i) + 1
                continue
            if c in "?*+" and runs and runs[-1]:
                runs[-1] = runs[-1][:-1]  # the quantified character is optional
        else:
            cur += c
        i += 1
    runs.append(cur)
    return max(runs, key=len)


def expand_patterns(rules: list[dict]) -> list[Pattern]:
    out: list[Pattern] = []
    for r in rules:
        py_lang = "py_content" if r["old_name"] == MULTI_LINE_RULE else "py"
        out += [Pattern(r["ord"], py_lang, p, _literal(p)) for p in python_patterns(r)]
        out += [Pattern(r["ord"], "xml", p, _literal(p)) for p in xml_patterns(r)]
    return out


def java_regex(p: str) -> str:
    """ASCII word boundaries for Java (its \\b also treats non-ASCII letters as
    word characters)."""
    return p.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


# --------------------------------------------------------------- code scan

def file_lines(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Files -> (path, ext, line_no (1-based), line)."""
    ext = F.lower(F.regexp_extract(F.col(path_col), r"(\.[^./\\]*)$", 1))
    return (files.select(F.col(path_col).alias("path"), ext.alias("ext"),
                         F.posexplode(F.split(F.col(content_col), "\n")).alias("pos", "line"))
            .select("path", "ext", (F.col("pos") + 1).cast("long").alias("line_no"), "line"))


def is_comment(trimmed: Column) -> Column:
    """C26: '#', '<!--' or '//' at the start of the trimmed line."""
    return trimmed.startswith("#") | trimmed.startswith("<!--") | trimmed.startswith("//")


def literal_hits(text: Column, literals: list[str]) -> Column:
    """Indices of ``literals`` occurring in ``text`` (array<int>), from one
    Aho-Corasick pass per value inside an Arrow-batched pandas UDF; the
    automaton is built once per batch.  Without the library, built-in
    ``contains`` tests give the same array."""
    lits = tuple(literals)
    try:
        import ahocorasick  # noqa: F401
    except ImportError:  # pragma: no cover
        return F.filter(F.array(*[F.when(text.contains(x), F.lit(i)) for i, x in enumerate(lits)]),
                        lambda x: x.isNotNull())

    @F.pandas_udf("array<int>")
    def _hits(s: pd.Series) -> pd.Series:
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, w in enumerate(lits):
            a.add_word(w, i)
        a.make_automaton()
        return s.map(lambda t: sorted({i for _, i in a.iter(t)}) if t is not None else [])

    # non-deterministic: keeps the optimizer from copying the UDF call into
    # the filter that follows (one Aho-Corasick pass per line, not two)
    return _hits.asNondeterministic()(text)


def _sql_str(v: str) -> str:
    """A Spark SQL string literal (backslash and quote escaped)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits_type() -> str:
    return "array<struct<src:int,ord:int>>"


def code_scan(lines: DataFrame, rules: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """R13 + J10 + W13 + X3: findings per (file, line, rule), then the first
    per (file, line, old_name, field, model) in rule order (line findings
    before whole-content ones).  Only .py and .xml files are scanned;
    comment lines are skipped except by the whole-content rule, which sees single
    lines here; ``scan_files`` gives it the whole text."""
    return _findings(_line_hits(lines, patterns), rules)


def scan_files(files: DataFrame, rules: DataFrame, patterns: list[Pattern], path_col: str = "path",
               content_col: str = "content") -> DataFrame:
    """R13 + R14 + J10 + W13: ``code_scan`` of whole files, where the whole-content patterns match
    across lines and report the line on which a match starts.  A NULL content has no findings."""
    by_line = _line_hits(file_lines(files, path_col, content_col), [p for p in patterns if p.lang != "py_content"])
    found = by_line
    for p in patterns:
        if p.lang == "py_content":
            found = found.unionByName(_content_hits(files, p, path_col, content_col))
    return _findings(found, rules)


def _content_hits(files: DataFrame, p: Pattern, path_col: str, content_col: str) -> DataFrame:
    """Matches of one pattern in whole .py files, with the line that each starts on.

    The text is cut at the matches; the line breaks of the pieces and matches before a match
    give its line number, and the line is read from the split text: one projection over the files
    that hold the pattern's literal, no shuffle and no row a line."""
    rx = F.lit(java_regex(p.regex))
    ext = F.lower(F.regexp_extract(F.col(path_col), r"(\.[^./\\]*)$", 1))
    text = (files.select(F.col(path_col).alias("path"), ext.alias("ext"), F.col(content_col).alias("_text"))
            .filter((F.col("ext") == ".py") & F.col("_text").contains(p.literal)))

    def breaks(c: Column) -> Column:
        return F.size(F.split(c, "\n")) - 1

    cut = text.select("path", "ext", F.split("_text", "\n").alias("_lines"), F.split("_text", java_regex(p.regex)).alias("_between"),
                      F.regexp_extract_all("_text", rx, F.lit(0)).alias("_match"))
    pairs = F.transform("_match", lambda m, i: F.struct(breaks(F.get("_between", i)).alias("before"), breaks(m).alias("inside")))
    start = F.struct(F.lit(0).alias("line"), F.array().cast("array<int>").alias("at"))
    at = F.aggregate(pairs, start, lambda acc, x: F.struct(
        (acc["line"] + x["before"] + x["inside"]).alias("line"),
        F.array_append(acc["at"], acc["line"] + x["before"]).alias("at")))["at"]
    hits = cut.select("path", "ext", "_lines", F.array_distinct(at).alias("_at"))
    hits = hits.select("path", "ext", F.explode(F.transform("_at", lambda n: F.struct(
        (n + 1).cast("long").alias("line_no"), F.get("_lines", n).alias("line")))).alias("_h"))
    return hits.select("path", "ext", "_h.line_no", "_h.line", F.lit(p.ord).alias("ord"), F.lit(1).alias("_src"))


def _line_hits(lines: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(path, ext, line_no, line, ord, _src) of every rule that fires on a line."""
    lits = sorted({p.literal for p in patterns if p.literal})
    lit_id = {x: i for i, x in enumerate(lits)}
    d = (lines.filter(F.col("ext").isin(".py", ".xml"))
         .withColumn("_comment", is_comment(ltrim_ws(F.col("line"))))
         .withColumn("_lits", literal_hits(F.col("line"), lits)))
    if all(p.literal for p in patterns):
        d = d.filter(F.size("_lits") > 0)  # lines without any rule's target name cannot match
    arrays = []
    for lang, src_rank in (("py", 0), ("xml", 0), ("py_content", 1)):
        pats = [p for p in patterns if p.lang == lang]
        if not pats:
            continue
        ext = ".xml" if lang == "xml" else ".py"
        cond = F.col("ext") == ext
        if lang != "py_content":
            cond = cond & ~F.col("_comment")

        # one SQL expression for the whole pattern set: a single parse instead of
        # thousands of client-side Column constructions
        arms_sql = []
        for p in pats:
            rx = f"line RLIKE {_sql_str(java_regex(p.regex))}"
            test = f"array_contains(_lits, {lit_id[p.literal]}) AND {rx}" if p.literal else rx
            arms_sql.append(f"CASE WHEN {test} THEN named_struct('src', {src_rank}, 'ord', {p.ord}) END")
        hits = F.expr(f"array_distinct(filter(array({', '.join(arms_sql)}), x -> x IS NOT NULL))")
        arrays.append(F.when(cond, hits).otherwise(F.array().cast(hits_type())))
    # one pass over the lines: all three pattern sets evaluated in one projection
    return (d.select("path", "ext", "line_no", "line", F.explode(F.concat(*arrays)).alias("_h"))
            .select("path", "ext", "line_no", "line", F.col("_h.ord").alias("ord"), F.col("_h.src").alias("_src")))


def _findings(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules' columns, one finding per (file, line, old_name, field, model), and the trimmed line."""
    r = F.broadcast(rules.select(*RULE_COLUMNS))
    j = found.join(r, "ord")
    key = ["path", "line_no", "old_name", "field", "model"]
    first = (j.groupBy(*key).agg(F.min(F.struct("_src", "ord")).alias("_k"))
             .select(*key, F.col("_k.ord").alias("ord"), F.col("_k._src").alias("_src")))
    snip = trim_ws(F.col("line"))
    return (j.join(first, key + ["ord", "_src"])
            .withColumn("snippet", F.when(F.length(snip) > 200, F.concat(F.substring(snip, 1, 200), F.lit("…")))
                        .otherwise(snip))
            .select("path", "line_no", "ord", "kind", "severity", "model", "field", "old_name", "new_name",
                    "from_version", "to_version", "snippet"))


def schema_index_from_json(snapshots: DataFrame, env_col: str = "env_id", json_col: str = "models") -> DataFrame:
    """SRC6 / N4: schema snapshot JSON {model: {fields: {name: ...}}} -> (env,
    model, field) with lower-cased names.  The map is parsed as
    map<string,string> first so one malformed model does not void the rest;
    a model whose value does not parse is present with no fields."""
    outer = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    m = snapshots.select(env_col, F.explode(outer).alias("model", "raw"))
    fields = F.from_json(F.col("raw"), T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))
    return (m.select(env_col, F.lower("model").alias("model"), F.map_keys(fields["fields"]).alias("_f"))
            .select(env_col, "model", F.explode_outer("_f").alias("field"))
            .withColumn("field", F.lower("field")))
