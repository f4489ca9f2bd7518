"""Access traces over rule tables: conditions, stages and suggestions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from vantage.operators import access as ac
from vantage.operators import access_rules as ar

FIELDS = {"num": "num", "name": "str", "flag": "bool", "gone": "num"}
RECORD = "num double, name string, flag boolean, gone double"
ACCESS = "model string, pos int, group_id string, perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean"
RULES = "model string, pos int, name string, group_ids array<int>, domain string, perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean"
REQUEST = "request_id int, uid int, login string, user_found boolean, active boolean, company_id int, company_ids array<int>, n_direct int, effective array<int>, model string, op string, has_record boolean, " + RECORD


def test_stack_machine_equals_the_compiler(spark):
    rng = random.Random(4)

    def leaf():
        field = rng.choice(["num", "name", "flag", "gone", "missing"])
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "in", "not in", "like", "not like", "ilike", "=like", "=ilike", "not ilike", "child_of"])
        value = rng.choice(["1", "2.5", "'abc'", "'A%'", "'a_c'", "False", "True", "None", "user.id", "company_ids", "user.nobody", "[1, 'abc']",
                            "['x', user.id]", "[user.nobody]", "(2, 3)"])
        return f"('{field}', '{op}', {value})"

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return [leaf()]
        op = rng.choice(["'&'", "'|'", "'!'"])
        return [op, *tree(depth - 1), *([] if op == "'!'" else tree(depth - 1))]

    domains = [f"[{', '.join(tree(3))}]" for _ in range(150)] + [f"[{leaf()}, {leaf()}]" for _ in range(60)] + ["[]", "[('a',", "", "['|', ('num', '=', 1)]"]
    records = [(1.0, "abc", True, None), (2.5, "Abc", False, None), (0.0, None, None, None), (3.0, "x", True, 7.0)]
    frame = spark.createDataFrame([(i, *r, 5 if i % 2 else 1, 1, [1, 3]) for i, r in enumerate(records)],
                                  f"id int, {RECORD}, uid int, company_id int, company_ids array<int>")
    code = ar.compiled(spark.createDataFrame([(d,) for d in domains], "domain string"))
    results = ar._evaluated(F.col("conditions"))
    rows = frame.withColumn("record", ar.record_of(FIELDS)).join(code).withColumn("results", results)
    got = {(r.id, r.domain): (r.holds, r.results) for r in rows.withColumn(
        "holds", F.col("parse_error").isNull() & ar._run(F.col("program"), F.transform("results", lambda c: c["pass"]))).collect()}
    values = {f: ac.Val(F.col(f), k) for f, k in FIELDS.items()}
    refs = {"user.id": ac.Val(F.col("uid").cast("double"), "num"), "company_ids": ac.Val(F.transform("company_ids", lambda x: x.cast("double")), "list")}
    want = frame.select("id", *[ac.domain_column(d, values, refs).alias(f"d{i}") for i, d in enumerate(domains)]).collect()
    for r in want:
        for i, d in enumerate(domains):
            assert got[r.id, d][0] == r[f"d{i}"], (d, records[r.id])
    errors = {c.error for _, (_, cs) in got.items() for c in cs if c.error}
    assert errors == {'field "missing" not found in record data', ar.UNRESOLVED % "user.nobody"}


def plain_trace(q, models, access, record, holds):
    """Stages of one request, rule after rule."""
    out = [("user", "DENIED" if not q["user_found"] or not q["active"] else "OK")]
    if out[-1][1] != "OK" or q["uid"] == 1:
        return out
    out.append(("groups", "OK"))
    if q["model"] not in models:
        return out + [("model_acl", "ERROR")]
    at = 3 + ar.OPS.index(q["op"])
    mine = [a for a in access if a[0] == q["model"]]
    applies = [a for a in mine if a[2] in ("", "0") or a[2].lstrip("-").isdigit() and int(a[2]) in q["effective"]]
    if not any(a[at] for a in applies):
        return out + [("model_acl", "DENIED")]
    out.append(("model_acl", "OK"))
    cover = [r for r in record if r[0] == q["model"] and (r[5 + at - 3] or not any(r[5:]))]
    if not cover:
        return out + [("record_rule", "SKIPPED")]
    groups = [r for r in cover if r[3]]
    member = [r for r in groups if set(r[3]) & set(q["effective"])]
    if groups and not member:
        return out + [("record_rule", "DENIED")]
    out.append(("record_rule", "OK"))
    if not q["has_record"]:
        return out + [("domain", "SKIPPED")]
    fine = all(holds(q, r[4]) for r in cover if not r[3]) and (not member or any(holds(q, r[4]) for r in member))
    return out + [("domain", "OK" if fine else "DENIED")]


@pytest.fixture(scope="module")
def case(spark):
    """10 000 record rules over 400 models, requests of every kind."""
    rng = random.Random(9)
    domains = ["[]", "[('num', '>', 4)]", "['|', ('name', '=', 'a'), ('num', '<=', 2)]", "[('num', '=', user.id)]", "broken"]
    flags = lambda p: tuple(rng.random() < p for _ in range(4))
    access = [(f"m{rng.randrange(380)}", i, rng.choice(["", "0", "x"] + [str(g) for g in range(12)]), *flags(0.5)) for i in range(1200)]
    record = [(f"m{rng.randrange(20, 400)}", i, f"rule {i}", rng.sample(range(12), rng.choice([0, 2, 3, 4])), rng.choice(domains),
               *(flags(0.3) if rng.random() < 0.9 else (False,) * 4)) for i in range(10_000)]
    asked = [(i, rng.choice([1, 2, 5, 6]), "login", rng.random() < 0.95, rng.random() < 0.95, 1, [1, 2], 1, rng.sample(range(12), 2),
              f"m{rng.randrange(403)}", rng.choice(ar.OPS), rng.random() < 0.9, float(rng.randrange(8)), rng.choice("ab"), True, None) for i in range(600)]
    models = [f"m{i}" for i in range(400)]
    frame = spark.createDataFrame(asked, REQUEST).withColumn("record", F.when(F.col("has_record"), ar.record_of(FIELDS)))
    schema = spark.createDataFrame([(m,) for m in [*models, "res.users", "res.groups"]], "model string")
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return frame, schema, spark.createDataFrame(access, ACCESS), spark.createDataFrame(record, RULES), \
        [dict(zip(names, a)) for a in asked], set(models), access, record


def test_trace_over_ten_thousand_rules(case):
    frame, schema, access_frame, rule_frame, asked, models, access, record = case
    truth = {"[]": lambda q: True, "[('num', '>', 4)]": lambda q: q["num"] > 4, "broken": lambda q: False,
             "['|', ('name', '=', 'a'), ('num', '<=', 2)]": lambda q: q["name"] == "a" or q["num"] <= 2,
             "[('num', '=', user.id)]": lambda q: q["num"] == q["uid"]}
    traced = ar.suggestions(ar.trace(frame, schema, access_frame, rule_frame)).collect()
    assert len(traced) == len(asked)
    seen = set()
    for r in traced:
        want = plain_trace(asked[r.request_id], models, access, record, lambda q, d: truth[d](q))
        assert [(s.stage, s.verdict) for s in r.stages] == want
        bad = [s for s in want if s[1] in ("DENIED", "ERROR")]
        assert r.verdict == ("DENIED" if bad else "ALLOWED") and r.failing_stage == (bad[0][0] if bad else None)
        assert bool(r.suggestions) == bool(bad) and all(s.stage == r.failing_stage for s in r.suggestions)
        seen.add(want[-1])
    assert seen == {("user", "DENIED"), ("user", "OK"), ("model_acl", "ERROR"), ("model_acl", "DENIED"), ("record_rule", "SKIPPED"),
                    ("record_rule", "DENIED"), ("domain", "SKIPPED"), ("domain", "OK"), ("domain", "DENIED")}


def test_suggestion_texts(spark):
    schema = spark.createDataFrame([(m,) for m in ("res.users", "res.groups", "sale.order", "res.partner", "stock.move")], "model string")
    access = spark.createDataFrame([("sale.order", 1, "10", True, False, False, False), ("res.partner", 1, "77", True, True, True, True),
                                    ("res.partner", 2, "78", True, True, True, True)], ACCESS)
    rules = spark.createDataFrame([("sale.order", 1, "own", [], "[('num', '=', user.id)]", True, False, False, False),
                                   ("sale.order", 2, "team", [10], "[('name', 'in', ['x', 'y']), ('missing', '=', 1)]", True, False, False, False),
                                   ("sale.order", 3, "boss", [99, 98], "[]", True, False, False, False)], RULES)
    people = [(1, 7, "ann", True, True, "sale.order", "read"), (2, 7, "ann", True, True, "sale.order", "write"),
              (3, 7, "ann", True, True, "res.partner", "read"), (4, 7, "ann", True, True, "stock.move", "read"),
              (5, 7, "ann", True, False, "sale.order", "read"), (6, 8, None, False, None, "sale.order", "read"), (7, 7, "ann", True, True, "x.y", "read")]
    rows = [(i, u, login, found, active, 1, [1], 1, [10], m, op, True, 3.0, "z", True, None) for i, u, login, found, active, m, op in people]
    frame = spark.createDataFrame(rows, REQUEST).withColumn("record", ar.record_of(FIELDS))
    got = {r.request_id: r for r in ar.suggestions(ar.trace(frame, schema, access, rules)).collect()}
    one = got[1].suggestions
    assert [s.summary for s in one] == ['Global rule "own" domain failed', "No group record rule domain matched the record"]
    assert "Failed condition(s): num = 7 (actual: 3)." in one[0].detail and one[0].severity == "high"
    assert ("team (domain: [('name', 'in', ['x', 'y']), ('missing', '=', 1)], failed: name in [x y] (actual: z); missing: field \"missing\" not "
            "found in record data)\n  - boss (domain: [], failed: : rule does not apply to user's groups)") in one[1].detail
    assert got[1].stages[-1].reason == 'model "sale.order" read: DENIED — 1 global rule(s) failed; no group rule domain passed'
    assert got[2].suggestions[0].summary == "Grant write permission on existing access rule(s)"
    assert got[3].suggestions[0].summary == 'Add the user to a group that has read access on "res.partner"'
    assert "(group IDs: 77, 78)" in got[3].suggestions[0].detail
    assert got[4].suggestions[0].summary == 'Create an ir.model.access rule for model "stock.move"' and "access_stock_move_user," in got[4].suggestions[0].detail
    assert [s.summary for s in got[5].suggestions] == ["Re-activate the user account"]
    assert [s.summary for s in got[6].suggestions] == ["Verify the user exists in this Odoo database"]
    assert got[7].suggestions[0].summary == 'Stage "model_acl" returned an error — check schema snapshot' and got[7].verdict == "DENIED"


def test_many_cases_are_joined_without_broadcast(spark):
    cases = spark.createDataFrame([("m", "read", "1,2", [1, 2]), ("n", "write", "", [])], "model string, op string, groups string, effective array<int>")
    access = spark.createDataFrame([("m", 0, "1", True, False, False, False), ("n", 1, "", True, True, False, False)], ACCESS)
    record = spark.createDataFrame([("m", 0, "a", [2], "[]", True, True, False, False), ("n", 1, "b", [], "[]", False, False, False, False)], RULES)
    for few, many in ((ar.access_counts(cases, access), ar.access_counts(cases, access, True)),
                      (ar.case_rules(cases, ar.covering_rules(record)), ar.case_rules(cases, ar.covering_rules(record), True))):
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) != []
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_results_are_bound_once_and_verdicts_write_no_reasons(spark, case):
    """The fold names no expression of its results, and a plan that asks for verdicts formats no text."""
    frame, schema, access, rules = case[:4]
    out = spark.range(1).select(ar._run(F.array(F.lit(0), F.lit(1), F.lit(ar.AND)), F.transform(F.array(F.col("id"), F.col("id") + 1), lambda x: x < 2)).alias("r"))
    assert out.first().r and "transform(" not in out._jdf.queryExecution().analyzed().toString().split("aggregate(", 1)[1]
    plan = ar.trace(frame, schema, access, rules).select("request_id", "failing_stage", "verdict")._jdf.queryExecution().optimizedPlan().toString()
    assert "rule(s) failed" not in plan and "rule(s) grant access" not in plan and "collect_list" not in plan


def test_many_cases_give_what_few_do(spark, case, monkeypatch):
    """Rules looked up in the request's row, and rules joined case by case: the same rows, also where ids, rules and groups repeat or
    are null.  The row's way deals the requests out once and unfolds nothing."""
    frame, schema, access, rules = case[:4]
    odd = frame.filter("request_id < 60")
    frame = (frame.unionByName(odd.filter("request_id < 20")).unionByName(odd.filter("request_id < 30").withColumn("op", F.lit("read")))
             .unionByName(odd.filter("request_id % 7 = 0").withColumn("request_id", F.col("request_id") + 1000).withColumn("model", F.lit(None).cast("string")))
             .unionByName(odd.filter("request_id % 7 = 1").withColumn("request_id", F.col("request_id") + 1000).withColumn("op", F.lit(None).cast("string")))
             .unionByName(odd.filter("request_id % 7 = 2").withColumn("request_id", F.col("request_id") + 1000).withColumn("op", F.lit("none")))
             .unionByName(odd.filter("request_id % 7 = 3").withColumn("request_id", F.lit(None).cast("int")))
             .unionByName(odd.filter("request_id % 7 = 4").withColumn("request_id", F.col("request_id") + 1000).withColumn("effective", F.array(F.lit(3), F.lit(None), F.lit(3), F.lit(8))))
             .unionByName(odd.filter("request_id % 7 = 5").withColumn("request_id", F.col("request_id") + 1000).withColumn("effective", F.lit(None).cast("array<int>"))))
    access = access.unionByName(access.filter("pos < 100")).unionByName(access.filter("pos < 50").withColumn("group_id", F.lit(None).cast("string")))
    rules = (rules.unionByName(rules.filter("pos < 200")).unionByName(rules.filter("pos < 150").withColumn("model", F.lit(None).cast("string")))
             .unionByName(rules.filter("pos BETWEEN 300 AND 600").withColumn("pos", F.col("pos") + 20000).withColumn("domain", F.lit(None).cast("string")))
             .unionByName(rules.filter("pos BETWEEN 600 AND 900").withColumn("pos", F.col("pos") + 20000).withColumn("group_ids", F.array(F.lit(None), F.lit(4)).cast("array<int>"))))
    got = {}
    for many in (10**9, 0):
        monkeypatch.setattr(ar, "MANY_CASES", many)
        out = ar.suggestions(ar.trace(frame, schema, access, rules))
        got[many] = sorted(map(str, out.select("request_id", "uid", "model", "op", *[f"v{i}" for i in range(1, 6)], "stages", "failing_stage", "verdict",
                                               "suggestions").collect()))
    assert [x for x in zip(got[0], got[10**9], strict=True) if x[0] != x[1]] == [] and len(got[0]) > 600
    monkeypatch.setattr(ar, "MANY_CASES", 0)
    plan = ar.trace(case[0], schema, access, rules).select("request_id", "stages")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Generate" not in plan  # requests with the lists of their model, rules with their compiled domains
    assert len(plan) < 200_000  # no filter or projection writes the evaluation out again
