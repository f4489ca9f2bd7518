"""Upgrade scans and access control against the reference's expected values."""

import pytest
from pyspark.sql import functions as F

from vantage.operators import access as ac
from vantage.operators import upgrade as up


def _scan(spark, files, frm, to):
    rules = up.rules_on_path(up.rules_df(spark), frm, to)
    df = spark.createDataFrame(files, "path string, content string")
    return up.code_scan(up.file_lines(df), rules, up.expand_patterns(up.load_rules())).collect()


def test_code_scan_model_renamed(spark):
    out = _scan(spark, [("a/models/x.py", "inv = self.env['account.invoice'].search([])\n# self.env['account.invoice']")],
                "14.0", "15.0")
    kinds = {(r.kind, r.severity, r.line_no) for r in out}
    assert ("model_renamed", "breaking", 1) in kinds
    assert all(r.line_no == 1 for r in out)  # the comment line is skipped


def test_code_scan_field_removed(spark):
    out = _scan(spark, [("m.py", "dom = [('user_type_id', '=', 5)]")], "15.0", "16.0")
    assert any(r.kind == "field_removed" and r.severity == "breaking" for r in out)
    out = _scan(spark, [("m.py", "if move.invoice_payment_state == 'paid':")], "16.0", "17.0")
    assert any(r.kind == "field_removed" and r.old_name in ("invoice_payment_state",) or
               r.field == "invoice_payment_state" for r in out)


def test_version_path(spark):
    with pytest.raises(ValueError):
        up.path_range("13.0", "17.0")
    rules = up.rules_df(spark)
    counts = {(r.from_version, r.to_version): r.rule_count for r in up.rule_counts(rules).collect()}
    assert counts == {("14.0", "15.0"): 24, ("15.0", "16.0"): 16, ("16.0", "17.0"): 22,
                      ("17.0", "18.0"): 14, ("18.0", "19.0"): 34}
    assert up.rules_on_path(rules, "15.0", "17.0").count() == 38


def test_group_closure(spark):
    edges = spark.createDataFrame([(10, 11), (11, 1), (20, 21), (21, 20), (30, 31), (30, 32), (31, 33), (32, 33),
                                   (40, 999)], "group_id int, implied_id int")
    clo = ac.group_closure(edges)
    users = spark.createDataFrame([(1, [10]), (2, [20]), (3, [30]), (4, [40])], "uid int, group_ids array<int>")
    g = {r.uid: (r.effective, r.implied) for r in ac.effective_groups(users, clo).collect()}
    assert g[1] == ([1, 10, 11], [1, 11])
    assert g[2] == ([20, 21], [21])          # cycle terminates
    assert g[3] == ([30, 31, 32, 33], [31, 32, 33])  # diamond, no duplicates
    assert g[4] == ([40, 999], [999])        # unknown id kept


def test_domain_parse():
    assert ac.parse_domain("['|', ('a','=',1), ('b','=',2), ('c','=',3)]")[0] == "&"
    assert ac.parse_domain("['!', '|', ('a','=',1), ('b','=',2)]")[0] == "!"
    assert ac.parse_domain("[]") == ("true",)


def test_domain_semantics(spark):
    df = spark.createDataFrame([("hello", None, 0.0)], "s string, p long, n double")
    f = {"s": ac.Val(F.col("s"), "str"), "p": ac.Val(F.col("p").cast("double"), "num"),
         "n": ac.Val(F.col("n"), "num")}

    def ev(d):
        return df.select(ac.domain_column(d, f, {}).alias("r")).first().r
    assert ev("[('s', 'like', 'h_llo')]") is True
    assert ev("[('s', 'like', 'h_lo')]") is False
    assert ev("[('p', '=', False)]") is True      # NULL equals False
    assert ev("[('n', '=', None)]") is True       # 0 equals None
    assert ev("[('s', '<', 5)]") is False and ev("[('s', '<=', 5)]") is True
    assert ev("[('missing', '=', 1)]") is False and ev("['!', ('missing', '=', 1)]") is True
    assert ev("[('s', 'child_of', 1)]") is True
    assert ev("[]") is True and ev("[('s', '=',") is False


def test_schema_index_from_json(spark):
    js = ('{"Sale.Order": {"fields": {"Partner_ID": {"type": "many2one"}, "amount": {}}}, '
          '"broken.model": "not-an-object", "res.partner": {"fields": {}}}')
    df = spark.createDataFrame([("e", js)], "env_id string, models string")
    rows = {(r.model, r.field) for r in up.schema_index_from_json(df).collect()}
    assert ("sale.order", "partner_id") in rows and ("sale.order", "amount") in rows
    assert ("broken.model", None) in rows and ("res.partner", None) in rows


def _scan_files(spark, content, frm, to, path="m/x.py"):
    rules = up.rules_on_path(up.rules_df(spark), frm, to)
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return {(r.line_no, r.old_name) for r in up.scan_files(df, rules, up.expand_patterns(up.load_rules())).collect()}


@pytest.mark.parametrize("code, rule", [
    ("x = record.sudo(user)", "sudo_with_user_arg"), ("x = r.sudo( self.env.user )", "sudo_with_user_arg"),
    ("from odoo.tools import pycompat", "tools.pycompat"), ("import odoo.tools.pycompat", "tools.pycompat"),
    ("import openerp", "openerp"), ("from openerp import models", "openerp"),
    ("def write(self, cr, uid, ids):", "cr_uid_context_signature"), ("    _defaults = {", "_defaults"),
    ("from odoo.exceptions import UserError, Warning", "odoo.exceptions.Warning")])
def test_method_patterns_of_the_first_step(spark, code, rule):
    assert (1, rule) in _scan_files(spark, code, "14.0", "15.0")


@pytest.mark.parametrize("code", ["class Warning(Exception):", "a_columns = 1", "x = sudo", "pool = 5", "self.env.uid",
                                  "self.env.context", "x.name_get_more()", "def _name_get(self):"])
def test_ordinary_code_fires_no_method_rule(spark, code):
    assert not _scan_files(spark, code, "14.0", "19.0")


def test_whole_content_rule_crosses_lines(spark):
    rule = up.MULTI_LINE_RULE
    text = "\n".join(["first = 1", "a = m.read_group(", "  # note", "  lazy=False)", "b = m.read_group(d, lazy = False)",
                      "c = m.read_group(d)", "end = lazy"])
    assert _scan_files(spark, text, "18.0", "19.0") == {(2, rule), (5, rule)}
    # two matches that start on one line are one finding; a match may end in another's line
    text = "m.read_group(x, lazy=False); m.read_group(\n y, lazy=False); m.read_group(z,\nlazy=False)"
    assert _scan_files(spark, text, "18.0", "19.0") == {(1, rule), (2, rule)}
    assert _scan_files(spark, None, "18.0", "19.0") == set()
    assert _scan_files(spark, text, "18.0", "19.0", "m/x.txt") == set()
