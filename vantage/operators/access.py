"""Access control: group closure (J20, X1, R5), domains (R9, §2.13).

* Group closure (J20) is a semi-naive fixpoint over the implication edges:
  each round joins the newly found pairs with the edges and keeps only pairs
  not seen before (``left_anti``), so cycles terminate and diamonds add no
  duplicates.  Lineage is cut with a reliable checkpoint every round.
* Domains (R9): parser, and a compiler of one domain to a Catalyst expression with
  two-valued logic, for filters known on the driver.
* Traces over rule tables are in ``access_rules``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.session import cut_lineage

OPS = ("read", "write", "create", "unlink")
OK, DENIED, ERROR, SKIPPED = "OK", "DENIED", "ERROR", "SKIPPED"


# ------------------------------------------------------------- group closure

def group_closure(edges: DataFrame, src: str = "group_id", dst: str = "implied_id",
                  max_rounds: int = 64) -> DataFrame:
    """All (group_id, implied_id) pairs reachable over one or more edges.
    Unknown target ids are kept; a group reaching itself through a cycle
    appears as its own implied id.

    Path doubling: each round joins the known pairs with themselves, so after
    k rounds every path of length <= 2^k is present (log2(diameter) rounds).
    Pairs already known are removed with ``left_anti``, cycles therefore
    terminate and diamonds add no duplicates.  Each round's new pairs are
    checkpointed into the shared checkpoint directory, so the union of
    checkpointed deltas never builds deep lineage."""
    known = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    for _ in range(max_rounds):
        step = (known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a"))
                .select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct())
        new = cut_lineage(step.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        known = cut_lineage(known.unionByName(new))
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return known.select(F.col("a").alias(src), F.col("b").alias(dst))


def effective_groups(users: DataFrame, closure: DataFrame, uid: str = "uid", groups: str = "group_ids") -> DataFrame:
    """effective = direct ∪ implied (sorted, distinct); implied-only =
    effective minus direct."""
    direct = users.select(uid, F.explode_outer(groups).alias("g"))
    imp = (direct.join(closure.select(F.col("group_id").alias("g"), F.col("implied_id").alias("i")), "g")
           .select(uid, F.col("i").alias("g")))
    allg = direct.unionByName(imp).filter(F.col("g").isNotNull())
    eff = allg.groupBy(uid).agg(F.array_sort(F.collect_set("g")).alias("effective"))
    out = users.join(eff, uid, "left").withColumn(
        "effective", F.coalesce(F.col("effective"), F.array().cast("array<int>")))
    return out.withColumn("implied", F.array_sort(F.array_except("effective", F.coalesce(groups, F.array().cast("array<int>")))))


# -------------------------------------------------------------- domain parse

@dataclass(frozen=True)
class Ref:
    name: str


_TOKEN = re.compile(r"""\s*(?:(?P<p>[\[\]\(\),])|(?P<s>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|"""
                    r"""(?P<n>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<w>[A-Za-z_][A-Za-z0-9_.]*))""")


class DomainError(ValueError):
    pass


def _tokens(text: str):
    pos, out = 0, []
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            if text[pos:].strip() == "":
                break
            raise DomainError(f"bad token at {pos}")
        pos = m.end()
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
    return out


def _value(toks, i):
    kind, tok = toks[i]
    if kind == "p" and tok in "[(":
        close = "]" if tok == "[" else ")"
        items, i = [], i + 1
        while not (toks[i][0] == "p" and toks[i][1] == close):
            v, i = _value(toks, i)
            items.append(v)
            if toks[i][0] == "p" and toks[i][1] == ",":
                i += 1
        return (items if close == "]" else tuple(items)), i + 1
    if kind == "s":
        return tok[1:-1].encode().decode("unicode_escape") if "\\" in tok else tok[1:-1], i + 1
    if kind == "n":
        return (float(tok) if any(c in tok for c in ".eE") else int(tok)), i + 1
    if kind == "w":
        consts = {"True": True, "False": False, "None": None}
        return (consts[tok] if tok in consts else Ref(tok)), i + 1
    raise DomainError(f"unexpected {tok!r}")


def parse_domain(text: str):
    """Domain text -> prefix tree: ('&'|'|', a, b) / ('!', a) / ('leaf', f, op, v)
    / ('true',).  Implicit AND: ``operands - binary operators - 1`` leading '&'."""
    toks = _tokens(text)
    if not toks:
        raise DomainError("empty")
    val, i = _value(toks, 0)
    if i != len(toks) or not isinstance(val, list):
        raise DomainError("domain must be one list")
    if not val:
        return ("true",)
    items = []
    for it in val:
        if it in ("&", "|", "!"):
            items.append(it)
        elif isinstance(it, (list, tuple)) and len(it) == 3:
            items.append(("leaf", it[0], it[1], it[2]))
        else:
            raise DomainError(f"bad element {it!r}")
    leaves = sum(1 for x in items if isinstance(x, tuple))
    binops = sum(1 for x in items if x in ("&", "|"))
    items = ["&"] * max(0, leaves - binops - 1) + items

    def build(j):
        if j >= len(items):
            raise DomainError("missing operand")
        x = items[j]
        if x == "!":
            a, j = build(j + 1)
            return ("!", a), j
        if x in ("&", "|"):
            a, j = build(j + 1)
            b, j = build(j)
            return (x, a, b), j
        return x, j + 1

    tree, j = build(0)
    if j != len(items):
        raise DomainError("trailing operands")
    return tree


# ------------------------------------------------------------ domain compile

@dataclass(frozen=True)
class Val:
    """A compiled operand: Column plus kind ('num', 'str', 'bool', 'null',
    'list')."""
    col: Column
    kind: str


def _lit(v) -> Val:
    if v is None:
        return Val(F.lit(None), "null")
    if isinstance(v, bool):
        return Val(F.lit(v), "bool")
    if isinstance(v, (int, float)):
        return Val(F.lit(float(v)), "num")
    if isinstance(v, str):
        return Val(F.lit(v), "str")
    raise DomainError("unsupported literal")


def _falsy(v: Val) -> Column:
    if v.kind == "num":
        return v.col.isNull() | (v.col == 0)
    if v.kind == "bool":
        return v.col.isNull() | ~v.col
    return v.col.isNull()


def _text(v: Val) -> Column:
    if v.kind == "num":  # integral values print without a fraction
        return F.when(v.col == F.floor(v.col), F.floor(v.col).cast("long").cast("string")).otherwise(v.col.cast("string"))
    return v.col.cast("string")


def _equal(a: Val, b: Val) -> Column:
    fa, fb = _falsy(a), _falsy(b)
    if a.kind == b.kind and a.kind in ("num", "str", "bool"):
        same = a.col == b.col
    else:
        same = _text(a) == _text(b)
    return (fa & fb) | (~fa & ~fb & F.coalesce(same, F.lit(False)))


def _cmp(a: Val, b: Val, op: str) -> Column:
    if a.kind != "num" or b.kind != "num":
        return F.lit(op in ("<=", ">="))
    both = a.col.isNotNull() & b.col.isNotNull()
    d = a.col - b.col
    lt = both & (d < -1e-9)
    gt = both & (d > 1e-9)
    return {"<": lt, ">": gt, "<=": ~gt, ">=": ~lt}[op]


def _like(a: Val, pattern, ci: bool) -> Column:
    if a.kind != "str" or not isinstance(pattern, str):
        return F.lit(False)
    plain = pattern.replace("\\", "\\\\")  # a backslash escapes nothing
    return F.coalesce(a.col.ilike(plain) if ci else a.col.like(plain), F.lit(False))  # a missing text matches nothing


def compile_domain(tree, fields: dict[str, Val], refs: dict[str, Val]) -> Column:
    """Tree -> boolean Column, two-valued (NULL never escapes a leaf)."""
    kind = tree[0]
    if kind == "true":
        return F.lit(True)
    if kind == "!":
        return ~compile_domain(tree[1], fields, refs)
    if kind in ("&", "|"):
        a, b = compile_domain(tree[1], fields, refs), compile_domain(tree[2], fields, refs)
        return (a & b) if kind == "&" else (a | b)
    _, field, op, value = tree
    if not isinstance(field, str) or field not in fields:
        return F.lit(False)          # missing field: condition false
    a = fields[field]
    if isinstance(value, Ref):
        if value.name not in refs:
            return F.lit(False)      # unresolvable reference
        b = refs[value.name]
    elif isinstance(value, (list, tuple)):
        if any(isinstance(x, Ref) and x.name not in refs for x in value):
            return F.lit(False)      # unresolvable reference inside a list
        b = None
    else:
        try:
            b = _lit(value)
        except DomainError:
            return F.lit(False)

    if op in ("child_of", "parent_of"):
        return F.lit(True)           # once its value resolves

    def in_list() -> Column:
        if b is not None and b.kind == "list":
            return F.exists(b.col, lambda x: _equal(a, Val(x, "num")))
        if b is not None:
            return _equal(a, b)
        out = F.lit(False)
        for x in value:
            try:
                xv = refs[x.name] if isinstance(x, Ref) else _lit(x)
            except (DomainError, KeyError):
                continue
            out = out | _equal(a, xv)
        return out

    if op in ("=", "=="):
        e = _equal(a, b) if b is not None and b.kind != "list" else F.lit(False)
    elif op in ("!=", "<>"):
        e = ~(_equal(a, b) if b is not None and b.kind != "list" else F.lit(False))
    elif op in ("<", ">", "<=", ">="):
        e = _cmp(a, b, op) if b is not None and b.kind != "list" else F.lit(op in ("<=", ">="))
    elif op == "in":
        e = in_list()
    elif op == "not in":
        e = ~in_list()
    elif op in ("like", "=like"):
        e = _like(a, value, False)
    elif op in ("ilike", "=ilike"):
        e = _like(a, value, True)
    elif op == "not like":
        e = ~_like(a, value, False)
    elif op == "not ilike":
        e = ~_like(a, value, True)
    else:
        e = F.lit(False)
    return F.coalesce(e, F.lit(False))


def domain_column(text: str, fields: dict[str, Val], refs: dict[str, Val]) -> Column:
    """Parse + compile; a parse error makes the rule fail, '[]' passes."""
    try:
        return compile_domain(parse_domain(text), fields, refs)
    except (DomainError, IndexError, TypeError):
        return F.lit(False)


# ------------------------------------------------------- rules as written down

@dataclass(frozen=True)
class AccessRule:
    model: str
    group_id: str          # '' or '0' = global
    perm_read: bool
    perm_write: bool
    perm_create: bool
    perm_unlink: bool


@dataclass(frozen=True)
class RecordRule:
    model: str
    name: str
    group_ids: tuple[int, ...]   # empty = global
    domain: str
    perm_read: bool = False
    perm_write: bool = False
    perm_create: bool = False
    perm_unlink: bool = False
