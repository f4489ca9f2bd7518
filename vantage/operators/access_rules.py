"""Access traces over rule tables (J15, R4, R6-R8, R10) and fix suggestions.

Rules, and the conditions inside them, are rows.  A trace needs no driver code per rule:

1. Each distinct domain text is parsed once, in a task, into an array of
   conditions and a program in postfix order (``compiled``).
2. What access rules say depends on (model, operation, effective groups) only.  Where these
   *cases* are few, membership (J15) is an equi-join of them with the rules on (model, group),
   counts are aggregates, and requests join their case.
3. A request that gets as far as the domains joins the rules of its case; each
   condition is evaluated against the record and kept, and the program runs on a
   stack in ``aggregate``.
4. Global rules are ANDed, applicable group rules ORed, per request.
5. Where cases are many, nearly every request is a case of its own.  Then the rules of a model are gathered
   in one row (``rule_lists``) that its requests join, and steps 2 to 4 are worked out in the
   request's row: requests are dealt out once, and what they unfold to never is.

Rule tables may have any number of rows; lists per case are as long as one model has rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vantage.operators.access import DENIED, ERROR, OK, OPS, SKIPPED, DomainError, Ref, parse_domain
from vantage.session import written

#: From so many cases on, requests join the rules of their model instead of cases, and by sorting: files of rules are
#: small beside what they unfold to, so Spark would hand whole tables to the driver.
MANY_CASES = 20_000
STAGES = ("user", "groups", "model_acl", "record_rule", "domain")
AND, OR, NOT = -1, -2, -3
BAD_DOMAIN = "not one well-formed list of conditions"

_VALUE = "kind string, num double, text string"
_CONDITION = f"field string, op string, {_VALUE}, items array<struct<kind:string,num:double,text:string>>"
_COMPILED = ("domain string, parse_error string, program array<int>, "
             "conditions array<struct<field:string,op:string,kind:string,num:double,text:string,"
             "items:array<struct<kind:string,num:double,text:string>>>>")

# Suggestion texts, as (stage, severity, summary, detail); %s are filled in.
TEXTS = {
    "error": ("%s", "medium", 'Stage "%s" returned an error — check schema snapshot',
              'The pipeline could not evaluate stage "%s": %s. Ensure the agent has pushed a recent schema snapshot that '
              "includes the relevant models."),
    "inactive": ("user", "low", "Re-activate the user account",
                 "Go to Settings > Users & Companies > Users, find the user, and set 'Active' to True. Inactive users cannot "
                 "access any Odoo resource."),
    "not found": ("user", "low", "Verify the user exists in this Odoo database",
                  "The user ID was not found in Odoo. Verify the uid is correct and the user has not been archived or deleted. "
                  "Check: Settings > Users & Companies > Users."),
    "no rules": ("model_acl", "medium", "Create an ir.model.access rule for model %s",
                 "No access rules exist for %s. Create a CSV line in your module's security/ir.model.access.csv:\n"
                 "  id,name,model_id:id,group_id:id,perm_read,perm_write,perm_create,perm_unlink\n"
                 "  access_%s_user,%s user,model_%s,base.group_user,1,0,0,0\n"
                 "Then upgrade the module."),
    "no grant": ("model_acl", "low", "Grant %s permission on existing access rule(s)",
                 "The user's groups match %s rule(s) for %s but none grant perm_%s. Edit the ir.model.access.csv entry and set "
                 "perm_%s=1 for the matching group(s), then upgrade the module."),
    "no member": ("model_acl", "medium", "Add the user to a group that has %s access on %s",
                  "%s rule(s) grant access to %s but the user doesn't belong to any of their groups (group IDs: %s). Either add "
                  "the user to one of these groups, or create a new ir.model.access rule for the user's group."),
    "no rule group": ("record_rule", "medium", "Add the user to a group that matches a record rule for %s",
                      "%s group-based ir.rule(s) exist [%s] but the user doesn't belong to their groups (group IDs: %s). Add the "
                      "user to one of these groups under Settings > Users & Companies > Users."),
    "global rule": ("domain", "high", "Global rule %s domain failed",
                    "Global ir.rule %s applies to ALL users and its domain %s evaluated to false. Failed condition(s): %s. Either "
                    "update the record's field values to satisfy the domain, or modify the rule's domain in Settings > Technical "
                    "> Security > Record Rules."),
    "group rules": ("domain", "medium", "No group record rule domain matched the record",
                    "All applicable group-based ir.rule domains evaluated to false. At least one must pass (they are ORed). "
                    "Failed rules:\n  - %s\n"
                    "Fix options: (1) change the record's data to match a rule, (2) relax a rule's domain, or (3) add a new rule "
                    "with a matching domain for the user's group."),
}
# The reasons of verdicts.
REASONS = {
    "no users": "model 'res.users' not found in schema snapshot",
    "no user": "user not found — no data returned from Odoo",
    "inactive": "user %s (%s) is inactive",
    "superuser": "user %s (%s) is SUPERUSER — all checks bypassed",
    "user": "user %s (%s) resolved — %s groups",
    "no groups model": "model 'res.groups' not found in schema snapshot",
    "no groups": "user %s (%s) has no groups — only global rules will apply",
    "groups": "user %s (%s): %s direct groups + %s implied = %s effective groups",
    "no model": "model %s not found in schema snapshot",
    "no access": "no ir.model.access rules defined for model %s — access denied by default",
    "granted": "model %s %s: ALLOWED — %s of %s rule(s) grant access",
    "no member": "model %s %s: DENIED — %s rule(s) exist but none apply to user's groups",
    "no grant": "model %s %s: DENIED — %s applicable rule(s), none grant %s permission",
    "no rules": "no ir.rule entries for model %s — record-level access unrestricted",
    "no rules for op": "no ir.rule entries for model %s cover operation %s — record-level access unrestricted",
    "no rule group": "model %s %s: DENIED — %s group rule(s) exist but none match user's groups; user must belong to at least one "
                     "rule's groups",
    "rules": "model %s %s: %s rule(s) apply (%s global, %s group) — domains must be evaluated",
    "no record": "no record_data provided — domain evaluation skipped (provide record_data to evaluate ir.rule domains)",
    "domain": "model %s %s: all domain conditions satisfied (global: PASS, group: PASS)",
    "domain failed": "model %s %s: DENIED — %s",
}
NOT_APPLICABLE = "rule does not apply to user's groups"
UNRESOLVED = 'unresolvable reference "%s" — requires runtime data from Odoo'


def _say(text: str, *values) -> Column:
    return F.format_string(text, *[F.col(v) if isinstance(v, str) else v for v in values])


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


# ------------------------------------------------------------------ domains

def _literal(v) -> dict:
    if isinstance(v, Ref):
        return {"kind": "ref", "num": None, "text": v.name}
    if v is None:
        return {"kind": "null", "num": None, "text": "<nil>"}
    if isinstance(v, bool):
        return {"kind": "bool", "num": float(v), "text": str(v).lower()}
    if isinstance(v, (int, float)):
        return {"kind": "num", "num": float(v), "text": str(int(v)) if v == int(v) else repr(v)}
    if isinstance(v, (list, tuple)):
        return {"kind": "list", "num": None, "text": f"[{' '.join(_literal(x)['text'] for x in v)}]"}
    return {"kind": "str", "num": None, "text": v}


def postfix(tree) -> tuple[list[int], list[dict]]:
    """(program, conditions): a number from 0 pushes that condition's result, AND / OR / NOT combine the topmost ones."""
    program: list[int] = []
    conditions: list[dict] = []

    def put(node) -> None:
        if node[0] == "true":
            return
        if node[0] == "leaf":
            _, field, op, value = node
            if not isinstance(field, str) or not isinstance(op, str):
                raise DomainError("a condition is (field, operator, value)")
            items = [_literal(x) for x in value] if isinstance(value, (list, tuple)) else None
            program.append(len(conditions))
            conditions.append({"field": field, "op": op, **_literal(value), "items": items})
            return
        for child in node[1:]:
            put(child)
        program.append({"&": AND, "|": OR, "!": NOT}[node[0]])

    put(tree)
    return program, conditions


def compiled(domains: DataFrame) -> DataFrame:
    """Distinct texts of ``domain`` -> parse_error, program, conditions."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf.domain:
                try:
                    program, conditions = postfix(parse_domain(text))
                    rows.append((text, None, program, conditions))
                except (DomainError, IndexError, TypeError, UnicodeDecodeError):
                    rows.append((text, BAD_DOMAIN, [], []))
            yield pd.DataFrame(rows, columns=["domain", "parse_error", "program", "conditions"])

    return domains.select(F.coalesce("domain", F.lit("")).alias("domain")).distinct().mapInPandas(parse, _COMPILED)


def _struct(kind, num, text) -> Column:
    return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
                    num.cast("double").alias("num"), text.cast("string").alias("text"))


def number_text(x: Column) -> Column:
    """A double as plain digits, whole numbers without a fraction."""
    plain = F.when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.10f", x), "0+$", ""))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(plain)


def record_of(fields: dict[str, str]) -> Column:
    """The record of a request: column name -> (kind, num, text); ``fields`` says num, str or bool."""
    none = F.lit(None)
    values = []
    for name, kind in fields.items():
        c = F.col(name)
        value = {"num": lambda c: _struct("num", c, number_text(c.cast("double"))),
                 "bool": lambda c: _struct("bool", c.cast("int"), c), "str": lambda c: _struct("str", none, c)}[kind](c)
        values.append(F.when(c.isNull(), _struct("null", none, F.lit("<nil>"))).otherwise(value))
    return F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*values))


def _falsy(v: Column) -> Column:
    return (v["kind"] == "null") | (v["kind"].isin("num", "bool") & (F.coalesce(v["num"], F.lit(0.0)) == 0))


def _equal(a: Column, b: Column) -> Column:
    same = F.when((a["kind"] == "num") & (b["kind"] == "num"), a["num"] == b["num"]).otherwise(a["text"] == b["text"])
    return (_falsy(a) & _falsy(b)) | (~_falsy(a) & ~_falsy(b) & F.coalesce(same, F.lit(False)))


def _resolved(v: Column) -> Column:
    """A literal or reference -> (kind, num, text); kind 'error' with the name where it cannot be resolved."""
    known = {"user.id": F.col("uid"), "user.company_id": F.col("company_id"), "user.company_id.id": F.col("company_id")}
    lists = F.concat(F.lit("["), F.array_join(F.col("company_ids").cast("array<string>"), " "), F.lit("]"))
    out = F.when(v["kind"] != "ref", _struct(v["kind"], v["num"], v["text"]))
    for name, c in known.items():
        out = out.when(v["text"] == name, _struct("num", c, c))
    out = out.when(v["text"].isin("company_ids", "user.company_ids"), _struct("list", F.lit(None), lists))
    return out.otherwise(_struct("error", F.lit(None), v["text"]))


def _evaluated(conditions: Column) -> Column:
    """Conditions -> array of (field, op, expected, actual, error, pass).

    In three steps, each of which names what the next one uses several times."""
    def looked_up(c: Column) -> Column:
        listed = (c["kind"] == "ref") & c["text"].isin("company_ids", "user.company_ids")
        items = F.when(listed, F.transform("company_ids", lambda x: _struct("num", x, x))).otherwise(F.transform(c["items"], _resolved))
        return F.struct(c["field"].alias("field"), c["op"].alias("op"), _resolved(c).alias("own"), items.alias("items"),
                        F.element_at("record", c["field"]).alias("actual"))

    def expected(c: Column) -> Column:
        wrong = F.when(c["own"]["kind"] == "error", c["own"]["text"]).otherwise(
            F.get(F.filter(c["items"], lambda i: i["kind"] == "error"), F.lit(0))["text"])
        listed = F.concat(F.lit("["), F.array_join(F.transform(c["items"], lambda i: i["text"]), " "), F.lit("]"))
        value = F.when(c["own"]["kind"] == "list", _struct("list", F.lit(None), listed)).otherwise(c["own"])
        error = (F.when(wrong.isNotNull(), _say(UNRESOLVED, wrong))
                 .when(c["actual"].isNull(), F.concat(F.lit("field "), quoted(c["field"]), F.lit(" not found in record data"))))
        return F.struct(c["field"].alias("field"), c["op"].alias("op"), value.alias("expected"), c["items"].alias("items"),
                        c["actual"].alias("actual"), error.alias("error"))

    def judged(c: Column) -> Column:
        op, actual, value = c["op"], c["actual"], c["expected"]
        gap = F.when((actual["kind"] == "num") & (value["kind"] == "num"), actual["num"] - value["num"])
        less, more = F.coalesce(gap <= -1e-9, F.lit(False)), F.coalesce(gap >= 1e-9, F.lit(False))
        among = F.when(value["kind"] == "list", F.exists(c["items"], lambda i: _equal(actual, i))).otherwise(_equal(actual, value))
        texts = (actual["kind"] == "str") & (value["kind"] == "str")
        pattern = F.replace(value["text"], F.lit("\\"), F.lit("\\\\"))  # a backslash escapes nothing
        like, ilike = texts & F.like(actual["text"], pattern), texts & F.ilike(actual["text"], pattern)
        passes = F.when(op.isin("=", "=="), _equal(actual, value)).when(op.isin("!=", "<>"), ~_equal(actual, value))
        for names, holds in ((["<"], less), ([">"], more), (["<="], ~more), ([">="], ~less), (["in"], among), (["not in"], ~among),
                             (["like", "=like"], like), (["not like"], ~like), (["ilike", "=ilike"], ilike), (["not ilike"], ~ilike),
                             (["child_of", "parent_of"], F.lit(True))):
            passes = passes.when(op.isin(*names), holds)
        return F.struct(c["field"].alias("field"), op.alias("op"), value["text"].alias("expected"), actual["text"].alias("actual"),
                        c["error"].alias("error"), (c["error"].isNull() & F.coalesce(passes, F.lit(False))).alias("pass"))

    return F.transform(F.transform(F.transform(conditions, looked_up), expected), judged)


def _run(program: Column, results: Column) -> Column:
    """The postfix program on a stack of booleans; an empty program holds."""
    def step(results: Column, stack: Column, t: Column) -> Column:
        last, n = F.element_at(stack, -1), F.size(stack)
        below = F.get(stack, n - 2)
        return (F.when(t >= 0, F.concat(stack, F.array(F.get(results, t))))
                .when(t == NOT, F.concat(F.slice(stack, 1, n - 1), F.array(~last)))
                .otherwise(F.concat(F.slice(stack, 1, F.greatest(n - 2, F.lit(0))), F.array(F.when(t == AND, below & last).otherwise(below | last)))))

    def whole(results: Column) -> Column:
        return F.aggregate(program, F.array().cast("array<boolean>"), lambda stack, t: step(results, stack, t),
                           lambda stack: F.when(F.size(stack) == 0, F.lit(True)).otherwise(F.get(stack, F.lit(0))))

    # results are bound to a variable: named in the fold itself, they would be worked out again at each step
    return F.get(F.transform(F.array(results), whole), F.lit(0))


# -------------------------------------------------------------------- rules

def _perm(op: str) -> Column:
    return F.coalesce(F.col(f"perm_{op}"), F.lit(False))


CASE = ["model", "op", "groups"]


def _sorted(df: DataFrame, many: bool) -> DataFrame:
    """``df`` as a side of a join: never broadcast if there are ``many`` cases."""
    return df.hint("merge") if many else df


def access_counts(cases: DataFrame, rules: DataFrame, many: bool = False) -> DataFrame:
    """R6 with J15: per case the applicable and granting access rules.  ``rules``: model, pos, group_id text, perm_*."""
    anyone = F.coalesce("group_id", F.lit("")).isin("", "0")
    flat = rules.select("model", F.when(anyone, F.lit(None)).otherwise(F.expr("try_cast(group_id AS INT)")).alias("g"),
                        anyone.alias("anyone"), F.posexplode(F.array(*[_perm(o) for o in OPS])).alias("o", "grants"))
    flat = flat.withColumn("op", F.get(F.array(*[F.lit(o) for o in OPS]), F.col("o")))
    each = flat.groupBy("model", "op", "anyone", "g").agg(F.count(F.lit(1)).alias("n"), F.count_if("grants").alias("y"))
    member = cases.select(*CASE, F.explode("effective").alias("g")).join(_sorted(each.filter("g IS NOT NULL"), many), ["model", "op", "g"])
    everyone = cases.select(*CASE).join(_sorted(each.filter("anyone"), many), ["model", "op"])
    return (member.select(*CASE, "n", "y").unionByName(everyone.select(*CASE, "n", "y"))
            .groupBy(*CASE).agg(F.sum("n").alias("n_applicable"), F.sum("y").alias("n_granting")))


def _covered(rules: DataFrame) -> DataFrame:
    """Record rules with ``ops``, the operations they cover: those whose flag is set, or all if none is."""
    none = ~(_perm("read") | _perm("write") | _perm("create") | _perm("unlink"))
    ops = F.filter(F.array(*[F.when(_perm(o) | none, F.lit(o)) for o in OPS]), lambda o: o.isNotNull())
    groups = F.coalesce("group_ids", F.array().cast("array<int>")).cast("array<int>")
    return rules.select("model", "pos", "name", groups.alias("group_ids"), (F.size(groups) == 0).alias("is_global"),
                        F.coalesce("domain", F.lit("")).alias("domain"), ops.alias("ops"))


def covering_rules(rules: DataFrame) -> DataFrame:
    """Record rules by (model, op) they cover.  ``rules``: model, pos, name, group_ids, domain, perm_*."""
    covered = _covered(rules)
    return covered.select(*[c for c in covered.columns if c != "ops"], F.explode("ops").alias("op"))


def case_rules(cases: DataFrame, covering: DataFrame, many: bool = False) -> DataFrame:
    """R7 with J15: the covering rules of each case, ``applies`` says whether the user is in one of the rule's groups."""
    member = (cases.select(*CASE, F.explode("effective").alias("g"))
              .join(_sorted(covering.select("model", "op", "pos", F.explode("group_ids").alias("g")), many), ["model", "op", "g"])
              .select(*CASE, "pos").distinct().withColumn("member", F.lit(True)))
    return (cases.select(*CASE).join(_sorted(covering, many), ["model", "op"]).join(_sorted(member, many), [*CASE, "pos"], "left")
            .withColumn("applies", F.col("is_global") | F.coalesce("member", F.lit(False))).drop("member"))


def rule_lists(schema: DataFrame, access_rules: DataFrame, record_rules: DataFrame) -> DataFrame:
    """Per model: ``in_schema``; ``access``, its access rules counted by group, and ``access_groups``, their texts in
    order; ``rules``, its record rules in order, compiled."""
    text = F.coalesce("group_id", F.lit(""))
    anyone = text.isin("", "0")
    access = (access_rules.withColumn("anyone", anyone).withColumn("g", F.when(~F.col("anyone"), F.expr("try_cast(group_id AS INT)")))
              .groupBy("model", "anyone", "g").agg(
                  F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(_perm(o)) for o in OPS]).alias("grants"),
                  F.collect_list(F.struct("pos", text.alias("text"))).alias("texts")))
    rules = _covered(record_rules).join(compiled(record_rules.select("domain")), "domain", "left")
    rule = F.struct("pos", "name", "group_ids", "is_global", "domain", "ops", "parse_error", "program", "conditions")
    entry = F.struct("anyone", "g", "n", "grants", "texts")
    parts = (access.select("model", entry.alias("access")).unionByName(rules.select("model", rule.alias("rule")), allowMissingColumns=True)
             .unionByName(schema.select("model", F.lit(True).alias("in_schema")), allowMissingColumns=True))
    lists = parts.groupBy("model").agg(F.collect_list("access").alias("access"), F.sort_array(F.collect_list("rule")).alias("rules"),
                                       F.coalesce(F.bool_or("in_schema"), F.lit(False)).alias("in_schema"))
    texts = F.transform(F.sort_array(F.flatten(F.transform("access", lambda a: a["texts"]))), lambda t: t["text"])
    return lists.withColumn("access_groups", F.when(F.size("access") > 0, F.array_join(texts, ", "))).withColumn(
        "access", F.transform("access", lambda a: a.dropFields("texts")))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda t, n: t + n)


def with_rule_lists(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """R6, R7 with J15 in the request's row: the columns of ``access_counts`` and what record rules say, and ``rules``,
    those that cover the operation, with ``applies``.  NULL for requests without model or operation."""
    ids = F.coalesce("effective", F.array().cast("array<int>"))
    known = F.col("model").isNotNull() & F.col("op").isNotNull()
    d = asked.join(lists.hint("merge"), "model", "left")
    at = F.array_position(F.array(*[F.lit(o) for o in OPS]), F.col("op")).cast("int")
    # each group of the user counts the rules of that group
    times = F.transform("access", lambda a: F.struct(a["n"].alias("n"), F.get(a["grants"], at - 1).alias("y"), F.when(
        a["anyone"], F.lit(1)).otherwise(F.size(F.filter(ids, lambda i: i == a["g"]))).alias("times")))
    covering = F.transform(F.filter("rules", lambda r: F.array_contains(r["ops"], F.col("op"))), lambda r: r.withField(
        "applies", r["is_global"] | F.coalesce(F.arrays_overlap(r["group_ids"], ids), F.lit(False))))
    facts = {"n_access": F.coalesce(_total(F.transform("access", lambda a: a["n"])), F.lit(0)),
             "access_groups": F.col("access_groups"), "in_schema": F.coalesce("in_schema", F.lit(False)), "has_rules": F.coalesce(F.size("rules") > 0, F.lit(False)),
             "matches": F.when(at > 0, F.filter(times, lambda a: a["times"] > 0)), "rules": covering}
    d = d.withColumns({k: F.when(known, v) for k, v in facts.items()}).drop("access")
    counts = {"n_applicable": _total(F.transform("matches", lambda a: a["n"] * a["times"])),
              "n_granting": _total(F.transform("matches", lambda a: a["y"] * a["times"])),
              "n_global": F.size(F.filter("rules", lambda r: r["is_global"])), "n_group": F.size(F.filter("rules", lambda r: ~r["is_global"])),
              "n_group_applied": F.size(F.filter("rules", lambda r: ~r["is_global"] & r["applies"]))}
    listed = F.transform(F.filter("rules", lambda r: ~r["is_global"]), lambda r: F.struct(r["pos"], r["name"], r["group_ids"]))
    none = F.array().cast(d.schema["rules"].dataType)
    d = d.withColumn("rules", F.when(known, F.coalesce("rules", none)))
    return d.withColumns({k: F.when(known, F.coalesce(v, F.lit(0))) for k, v in counts.items()} | {"group_rules": listed}).drop("matches")


def _judged(rules: Column) -> Column:
    """Covering rules with ``applies`` -> the results of a request, in order."""
    tried = F.transform(rules, lambda r: r.withField("conditions", F.when(r["applies"], _evaluated(r["conditions"]))))

    def judged(r: Column) -> Column:
        holds = r["applies"] & r["parse_error"].isNull() & _run(r["program"], F.transform(r["conditions"], lambda c: c["pass"]))
        return F.struct((~r["is_global"]).alias("grouped"), *[r[c].alias(c) for c in ("pos", "name", "domain", "applies")],
                        F.coalesce(holds, F.lit(False)).alias("pass"), r["parse_error"].alias("parse_error"), r["conditions"].alias("conditions"))

    return F.sort_array(F.transform(tried, judged))


def _shared(d: DataFrame, asked: DataFrame) -> DataFrame:
    """``results`` belong to a request: rows that repeat its id have those of all of them."""
    again = written(asked.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("request_id"))
    if again.isEmpty():
        return d
    of_all = (d.filter(F.col("results").isNotNull()).join(again, "request_id", "left_semi").groupBy("request_id")
              .agg(F.sort_array(F.flatten(F.collect_list("results"))).alias("of_all")))
    return d.join(of_all, "request_id", "left").withColumn("results", F.coalesce("of_all", "results")).drop("of_all")


def _with_cases(asked: DataFrame, schema: DataFrame, access_rules: DataFrame, record_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``asked`` with what the rules say of its case, the rules of each case)."""
    # groups are read back from their text: distinct rows of plain columns are hashed, rows beside an array are sorted
    ids_of = F.when(F.col("groups") == "", F.array().cast("array<int>")).otherwise(F.split("groups", ",").cast("array<int>"))
    cases = written(asked.select(*CASE).distinct().withColumn("effective", ids_of))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("group_id", F.lit("")).alias("g")))), lambda r: r["g"])
    by_model = access_rules.groupBy("model").agg(F.count(F.lit(1)).alias("n_access"), F.array_join(ids, ", ").alias("access_groups"))
    covering = covering_rules(record_rules)
    named = F.when(~F.col("is_global"), F.struct("pos", "name", "group_ids"))
    listed = covering.groupBy("model", "op").agg(
        F.count_if("is_global").alias("n_global"), F.count_if(~F.col("is_global")).alias("n_group"),
        F.sort_array(F.collect_list(named)).alias("group_rules"))
    of_case = case_rules(cases, covering)
    applied = of_case.filter(~F.col("is_global")).groupBy(*CASE).agg(F.count_if("applies").alias("n_group_applied"))
    models, with_rules = schema.select("model").distinct(), record_rules.select("model").distinct()
    facts = written(cases.select(*CASE).join(models.withColumn("in_schema", F.lit(True)), "model", "left")
             .join(by_model, "model", "left").join(access_counts(cases, access_rules), CASE, "left")
             .join(with_rules.withColumn("has_rules", F.lit(True)), "model", "left")
             .join(listed, ["model", "op"], "left").join(applied, CASE, "left")
             .fillna(0, ["n_access", "n_applicable", "n_granting", "n_global", "n_group", "n_group_applied"])
             .fillna(False, ["in_schema", "has_rules"]))
    return asked.join(facts, CASE, "left"), of_case


def _results(reached: DataFrame, of_case: DataFrame, record_rules: DataFrame) -> DataFrame:
    """Per request the results of the rules of its case."""
    ready = of_case.join(compiled(record_rules.select("domain")), "domain", "left")
    rows = (reached.select("request_id", *CASE, "uid", "company_id", "company_ids", "record").join(ready, CASE)
            .withColumn("conditions", F.when(F.col("applies"), _evaluated(F.col("conditions")))))
    holds = F.col("applies") & F.col("parse_error").isNull() & _run(F.col("program"), F.transform("conditions", lambda c: c["pass"]))
    # one checkable fact a rule: evaluated before it is gathered
    rows = rows.withColumn("pass", F.coalesce(holds, F.lit(False)))
    return rows.groupBy("request_id").agg(
        F.count_if(F.col("is_global") & ~F.col("pass")).alias("global_failed"),
        (F.bool_or(~F.col("is_global") & F.col("pass")) | ~F.bool_or(~F.col("is_global") & F.col("applies"))).alias("group_pass"),
        F.sort_array(F.collect_list(F.struct((~F.col("is_global")).alias("grouped"), "pos", "name", "domain", "applies", "pass",
                                             "parse_error", "conditions"))).alias("results"))


def trace(requests: DataFrame, schema: DataFrame, access_rules: DataFrame, record_rules: DataFrame) -> DataFrame:
    """One row per request with verdict and reason of each stage.

    ``requests``: request_id, uid, login, user_found, active, company_id, company_ids, n_direct,
    effective (array of group ids), model, op, record (``record_of``; NULL for none); ``schema``: model.
    Adds v1 to v5 (the verdict of each stage, NULL where the trace did not get), ``stages`` (array of stage, verdict, reason, in order, as far as the trace got), ``results``
    (the rules evaluated or listed in the last stage, with their conditions),
    failing_stage and verdict: ALLOWED unless a stage is DENIED or ERROR."""
    has = {r["model"] for r in schema.filter(F.col("model").isin("res.users", "res.groups")).select("model").distinct().collect()}
    groups = F.array_join(F.coalesce("effective", F.array().cast("array<int>")), ",")
    seen = Observation()
    asked = written(requests.withColumn("groups", groups).withColumn("recorded", F.col("record").isNotNull())
                    .observe(seen, F.approx_count_distinct(F.struct(*CASE)).alias("cases")))
    many = seen.get["cases"] >= MANY_CASES
    if many:
        d = with_rule_lists(asked, rule_lists(schema, access_rules, record_rules))
    else:
        d, of_case = _with_cases(asked, schema, access_rules, record_rules)

    def stage(*ways: tuple[Column | None, str, Column]) -> tuple[Column, Column]:
        """(verdict, reason) of the first way whose condition holds; None holds always.  Reasons are apart, so that
        none is written where only verdicts are asked for."""
        out = []
        for k in (1, 2):
            made = F
            for condition, *said in ways:
                value = F.lit(said[0]) if k == 1 else said[1]
                made = made.when(F.lit(True) if condition is None else condition, value)
            out.append(made)
        return out[0], out[1]

    model, uid, login = quoted(F.col("model")), F.col("uid").cast("string"), F.coalesce("login", F.lit(""))
    superuser = F.col("uid") == 1
    direct, effective = F.col("n_direct"), F.col("n_effective")
    n_access, r = F.col("n_access"), REASONS
    v1, r1 = stage((~F.coalesce("user_found", F.lit(False)), DENIED, F.lit(r["no user"])),
                   (~F.coalesce("active", F.lit(False)), DENIED, _say(r["inactive"], uid, login)),
                   (superuser, OK, _say(r["superuser"], uid, login)), (None, OK, _say(r["user"], uid, login, direct)))
    v2, r2 = stage((effective == 0, OK, _say(r["no groups"], uid, login)),
                   (None, OK, _say(r["groups"], uid, login, direct, effective - direct, effective)))
    if "res.users" not in has:
        v1, r1 = stage((None, ERROR, F.lit(r["no users"])))
    if "res.groups" not in has:
        v2, r2 = stage((None, ERROR, F.lit(r["no groups model"])))
    v3, r3 = stage((~F.col("in_schema"), ERROR, _say(r["no model"], model)), (n_access == 0, DENIED, _say(r["no access"], model)),
                   (F.col("n_granting") > 0, OK, _say(r["granted"], "model_q", "op", "n_granting", "n_access")),
                   (F.col("n_applicable") == 0, DENIED, _say(r["no member"], "model_q", "op", "n_access")),
                   (None, DENIED, _say(r["no grant"], "model_q", "op", "n_applicable", "op")))
    v4, r4 = stage((~F.col("has_rules"), SKIPPED, _say(r["no rules"], model)),
                   (F.col("n_global") + F.col("n_group") == 0, SKIPPED, _say(r["no rules for op"], "model_q", "op")),
                   ((F.col("n_group") > 0) & (F.col("n_group_applied") == 0), DENIED, _say(r["no rule group"], "model_q", "op", "n_group")),
                   (None, OK, _say(r["rules"], "model_q", "op", F.col("n_global") + F.col("n_group_applied"), "n_global", "n_group_applied")))
    d = (d.withColumn("n_effective", F.size(F.coalesce("effective", F.array().cast("array<int>"))))
         .withColumn("model_q", model).withColumn("v1", v1))
    for before, here, value in (("v1", "v2", v2), ("v2", "v3", v3), ("v3", "v4", v4)):
        open_ = (F.col(before) == OK) & (~superuser if before == "v1" else F.lit(True))
        d = d.withColumn(here, F.when(open_, value))
    # stage 5: the rules of the case against the record
    reached = (F.col("v4") == OK) & F.col("recorded")
    if many:
        d = d.withColumn("results", F.when(reached & F.col("request_id").isNotNull(), _judged(F.col("rules")))).drop("rules")
        # observed for the plan's sake: no filter on what follows is pushed below, which would write its expressions out there again
        d = _shared(d.observe(Observation(), F.count(F.lit(1)).alias("n")), asked)
        there = F.col("results").isNotNull()
        d = d.withColumn("global_failed", F.when(there, F.size(F.filter("results", lambda x: ~x["grouped"] & ~x["pass"])))).withColumn(
            "group_pass", F.when(there, F.exists("results", lambda x: x["grouped"] & x["pass"]) | ~F.exists("results", lambda x: x["grouped"] & x["applies"])))
    else:
        d = d.join(_results(d.filter(reached), of_case, record_rules).hint("merge"), "request_id", "left")  # one row a request
    over, under = F.col("global_failed") > 0, ~F.col("group_pass")
    failed = F.concat_ws("; ", F.when(over, _say("%s global rule(s) failed", "global_failed")), F.when(under, F.lit("no group rule domain passed")))
    fails = F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False))
    v5, r5 = stage((~F.col("recorded"), SKIPPED, F.lit(r["no record"])), (~fails, OK, _say(r["domain"], "model_q", "op")),
                   (None, DENIED, _say(r["domain failed"], "model_q", "op", failed)))
    d = d.withColumn("v5", F.when(F.col("v4") == OK, v5))
    passed = F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(n).alias("stage"), F.col(f"v{i}").alias("verdict"), reason.alias("reason")))
                       for i, (n, reason) in enumerate(zip(STAGES, (r1, r2, r3, r4, r5), strict=True), 1)])
    failing = F.coalesce(*[F.when(F.col(f"v{i}").isin(DENIED, ERROR), F.lit(n)) for i, n in enumerate(STAGES, 1)])
    return (d.withColumn("stages", F.filter(passed, lambda s: s.isNotNull())).withColumn("failing_stage", failing)
            .withColumn("verdict", F.when(F.col("failing_stage").isNull(), "ALLOWED").otherwise(DENIED)))


# -------------------------------------------------------------- suggestions

def _failed_conditions(rule: Column) -> Column:
    texts = F.transform(F.filter(rule["conditions"], lambda c: ~c["pass"]), lambda c: F.when(
        c["error"].isNotNull(), F.concat(c["field"], F.lit(": "), c["error"])).otherwise(
        F.concat_ws(" ", c["field"], c["op"], c["expected"], F.concat(F.lit("(actual: "), c["actual"], F.lit(")")))))
    return (F.when(~rule["applies"], F.lit(": " + NOT_APPLICABLE)).when(F.size(texts) > 0, F.array_join(texts, "; "))
            .when(rule["parse_error"].isNotNull(), F.concat(F.lit("parse error: "), rule["parse_error"])).otherwise(F.lit("unknown")))


def suggestions(traced: DataFrame) -> DataFrame:
    """``suggestions``, an array of (stage, severity, summary, detail), beside each request of ``trace``;
    empty where access is allowed."""
    def text(key: str, summary: tuple = (), detail: tuple = (), stage: Column | None = None) -> Column:
        where, severity, head, body = TEXTS[key]
        return F.struct((stage if stage is not None else F.lit(where)).alias("stage"), F.lit(severity).alias("severity"),
                        (_say(head, *summary) if summary else F.lit(head)).alias("summary"),
                        (_say(body, *detail) if detail else F.lit(body)).alias("detail"))

    fail = F.get(F.filter("stages", lambda s: s["verdict"].isin(DENIED, ERROR)), F.lit(0))
    stage, reason = fail["stage"], F.lower(fail["reason"])
    plain = F.replace(F.col("model"), F.lit("."), F.lit("_"))
    user = F.filter(F.array(F.when(reason.contains("inactive"), text("inactive")),
                            F.when(reason.contains("not found") | reason.contains("no data"), text("not found"))), lambda s: s.isNotNull())
    model = (F.when(F.col("n_access") == 0, text("no rules", ("model_q",), ("model_q", plain, "model", plain)))
             .when(F.col("n_applicable") > 0, text("no grant", ("op",), ("n_applicable", "model_q", "op", "op")))
             .otherwise(text("no member", ("op", "model_q"), ("n_access", "model_q", "access_groups"))))
    ids = F.array_distinct(F.flatten(F.transform("group_rules", lambda g: g["group_ids"]))).cast("array<string>")
    rule = text("no rule group", ("model_q",), ("n_group", F.array_join(F.transform("group_rules", lambda g: g["name"]), ", "),
                                                F.array_join(ids, ", ")))
    over = F.transform(F.filter("results", lambda x: ~x["grouped"] & ~x["pass"]), lambda x: text(
        "global rule", (quoted(x["name"]),), (quoted(x["name"]), x["domain"], _failed_conditions(x))))
    lines = F.transform(F.filter("results", lambda x: x["grouped"] & ~x["pass"]), lambda x: _say(
        "%s (domain: %s, failed: %s)", x["name"], x["domain"], _failed_conditions(x)))
    under = F.when(~F.col("group_pass"), F.array(text("group rules", (), (F.array_join(lines, "\n  - "),))))
    kind = "array<struct<stage:string,severity:string,summary:string,detail:string>>"
    none = F.array().cast(kind)
    made = (F.when(fail["verdict"] == ERROR, F.array(text("error", (stage,), (stage, fail["reason"]), stage)))
            .when(stage == "user", user).when(stage == "model_acl", F.array(model)).when(stage == "record_rule", F.array(rule))
            .when(stage == "domain", F.concat(over, F.coalesce(under, none))))
    return traced.withColumn("suggestions", F.coalesce(made.cast(kind), none))
