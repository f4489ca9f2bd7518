"""Table-driven checks of the scalar functions against the reference's
expected values (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from vantage.functions import errors as fe
from vantage.functions import scoring as sc
from vantage.functions import sqltext as st


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_normalize_sql(spark):
    cases = [("SELECT * FROM t WHERE name = 'John' AND id = 42", "SELECT * FROM t WHERE name = ? AND id = ?"),
             ("  SELECT 1  ", "SELECT ?"), ("x IN (1, 2, 3, 4, 5)", "x IN (?, ?, ?, ?, ?)"), ("", "")]
    for a, b in cases:
        assert one(spark, st.normalize_sql(F.col("a")), a) == b


def test_model_and_method_from_sql(spark):
    assert one(spark, st.model_from_sql(F.col("a")), 'SELECT "res_partner"."id" FROM "res_partner"') == "res.partner"
    assert one(spark, st.model_from_sql(F.col("a")), 'INSERT INTO "sale_order" (a) VALUES (1)') == "sale.order"
    assert one(spark, st.model_from_sql(F.col("a")), "SAVEPOINT sp1") == ""
    for sql, m in [("SELECT 1", "read"), ("select id from x", "read"), ("INSERT INTO x", "create"),
                   ("UPDATE x SET", "write"), ("DELETE FROM x", "unlink"), ("SAVEPOINT sp1", "unknown"),
                   ("", "unknown")]:
        assert one(spark, st.sql_method(F.col("a")), sql) == m


def test_impact_score_and_severity(spark):
    rows = [(0, 0, 0, 0.0), (1000, 10, 60, 15.0), (5000, 20, 150, 200.0)]
    for ms, occ, peak, want in rows:
        got = one(spark, sc.impact_score("ms", "occ", "peak"), ms, occ, peak, schema="ms int, occ int, peak int")
        assert got == want
    for s, want in [(0, "low"), (3, "low"), (5, "medium"), (29, "medium"), (30, "high"), (99, "high"),
                    (100, "critical"), (500, "critical")]:
        assert one(spark, sc.severity("a"), float(s), schema="a double") == want


def test_budget_alert_severity(spark):
    for pct, thr, want in [(25, 20, "warning"), (30, 20, "critical"), (40, 20, "critical"), (29.9, 20, "warning")]:
        assert one(spark, sc.budget_alert_severity("p", "t"), float(pct), thr, schema="p double, t int") == want


def test_module_path(spark):
    for path, want in [("/opt/odoo/addons/sale/models/sale_order.py", "sale/models/sale_order.py"),
                       ("/opt/odoo/odoo/http.py", "http.py"), ("/some/random/path/file.py", "file.py")]:
        assert one(spark, fe.module_path(F.col("a")), path) == want


def test_normalize_message_pairs(spark):
    pairs = [("Record 42 not found", "Record 789 not found"),
             ("id 550e8400-e29b-41d4-a716-446655440000 gone", "id 123e4567-e89b-12d3-a456-426614174000 gone"),
             ("mail a.b@example.com failed", "mail x@y.org failed"),
             ("at 2024-01-15T10:30:45 boom", "at 2023-11-02 08:00:01.123 boom"),
             ("from 10.0.0.1 denied", "from 192.168.1.20 denied")]
    for a, b in pairs:
        assert one(spark, fe.normalize_message(F.col("a")), a) == one(spark, fe.normalize_message(F.col("a")), b)
    assert one(spark, fe.normalize_message(F.col("a")), "\n  first line 7\nsecond") == "first line<?>"
    assert one(spark, fe.normalize_message(F.col("a")), "Record 42 not 7") == "Record<?>not<?>"


TB = ('Traceback (most recent call last):\n  File "/opt/odoo/addons/sale/models/sale_order.py", line 42, '
      'in action_confirm\n    raise ValidationError(msg)\nodoo.exceptions.ValidationError: Order {} cannot be confirmed')


def test_signature(spark):
    def sig(tb):
        return one(spark, fe.error_signature(F.lit("ValidationError"), F.col("a"), F.col("a")), tb)
    s1, s2 = sig(TB.format(42)), sig(TB.format(789))
    assert s1 == s2 and len(s1) == 16
    assert sig(TB.format(42).replace("sale/models", "stock/models")) != s1
    other = one(spark, fe.error_signature(F.lit("UserError"), F.col("a"), F.col("a")), TB.format(42))
    assert other != s1


def test_error_type_and_exception_line(spark):
    assert one(spark, fe.error_type(F.col("a")), TB.format(1)) == "odoo.exceptions.ValidationError"
    assert one(spark, fe.error_type(F.col("a")), "") == "UnknownError"
    r = one(spark, fe.exception_line(F.col("a")), "x\nKeyboardInterrupt\n\nDuring handling of the above")
    assert r["type"] == "KeyboardInterrupt" and r["message"] == ""
    r = one(spark, fe.exception_line(F.col("a")), "ValueError: bad: value")
    assert r["type"] == "ValueError" and r["message"] == "bad: value"
    assert one(spark, fe.short_type(F.col("a")), "odoo.exceptions.ValidationError") == "ValidationError"


def test_pct_hundredths(spark):
    assert one(spark, sc.pct_hundredths("a", "b"), 500, 1000, schema="a int, b int") == 50.0
    assert one(spark, sc.pct_hundredths("a", "b"), 1, 3, schema="a int, b int") == 33.33
    assert one(spark, sc.pct_hundredths("a", "b"), 2, 3, schema="a int, b int") == 66.67
