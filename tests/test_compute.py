"""Compute chains and compute events against ordered folds written out by hand."""

import random

import pytest

from pyspark.sql import functions as F

from vantage.operators import compute, nested

NODES = "rec string, idx int, model string, field_name string, method string, duration_ms int, depends_on array<string>, trigger_field string"


def fold(nodes):
    """R17 for one recording, node after node: the definition."""
    latest, past, out = {}, [], {}
    for idx, model, field, method, deps in sorted(nodes):
        latest[f"{model}.{field or method}"] = idx
        best, parent = -1, None
        for dep in deps or ():
            key = f"{model}.{dep}"
            if key in latest:
                for k, d in past:
                    if k == key and d > best:
                        best, parent = d, latest[key]
        depth = best + 1 if parent is not None else 0
        past.append((f"{model}.{field}", depth))
        out[idx] = (depth, "" if parent is None else f"compute-{parent}")
    return out


def random_nodes(rng, rec, n, fields):
    return [(rec, i, rng.choice("mn"), rng.choice(fields + [""]), rng.choice(fields + ["f0"]), rng.randint(0, 90),
             rng.sample(fields, rng.randint(0, min(3, len(fields)))) or None, rng.choice(["", "q", None])) for i in range(n)]


@pytest.mark.parametrize("positions", [4096, 3])
def test_chain_equals_the_fold(spark, monkeypatch, positions):
    monkeypatch.setattr(compute, "POSITIONS", positions)
    rng = random.Random(5)
    rows = [r for i in range(12) for r in random_nodes(rng, f"r{i}", rng.randint(1, 40), [f"f{k}" for k in range(rng.randint(1, 9))])]
    rows += [("line", i, "m", f"f{i}", "c", 1, [f"f{i - 1}"], "") for i in range(9)]  # one long chain
    chain = compute.compute_chain(spark.createDataFrame(rows, NODES)).collect()
    want = {}
    for rec in {r[0] for r in rows}:
        for idx, v in fold([(r[1], r[2], r[3], r[4], r[6]) for r in rows if r[0] == rec]).items():
            want[rec, idx] = v
    assert {(r.rec, r.idx): (r.depth, r.parent_id) for r in chain} == want
    assert max(d for d, _ in want.values()) >= 8 and any(p == f"compute-{k[1]}" for k, (_, p) in want.items())
    depths = compute.compute_depths(spark.createDataFrame(rows, NODES)).collect()
    assert {(r.rec, r.idx): r.depth for r in depths} == {k: d for k, (d, _) in want.items()}


@pytest.mark.parametrize("short", [1, 8, 64])
def test_short_recordings_are_folded_in_one_row(spark, monkeypatch, short):
    monkeypatch.setattr(compute, "SHORT", short)
    asked = []
    levels = compute.levels
    monkeypatch.setattr(compute, "levels", lambda nodes: asked.append(nodes.select("rec").distinct().count()) or levels(nodes))
    rng = random.Random(11)
    sizes = {f"r{i}": n for i, n in enumerate([1, 2, 3, 7, 8, 9, 12, 20])}
    rows = [r for rec, n in sizes.items() for r in random_nodes(rng, rec, n, ["a", "b", "c"])]
    chain = compute.compute_chain(spark.createDataFrame(rows + [(None, i, "m", "a", "c", 1, ["a"], "") for i in range(3)], NODES)).collect()
    got = {(r.rec, r.idx): (r.depth, r.parent_id) for r in chain}
    for rec in sizes:
        for idx, v in fold([(r[1], r[2], r[3], r[4], r[6]) for r in rows if r[0] == rec]).items():
            assert got.pop((rec, idx)) == v
    assert got == {(None, i): (0, "") for i in range(3)}  # no recording, no edges
    longer = sum(n > short for n in sizes.values())
    assert asked == ([longer] if longer else [])  # rounds for the others only


def test_stats_of_a_random_chain(spark):
    rng = random.Random(8)
    rows = [r for i in range(6) for r in random_nodes(rng, f"r{i}", rng.randint(1, 30), ["a", "b"])]
    chain = compute.compute_depths(spark.createDataFrame(rows, NODES))
    depth = {(r.rec, r.idx): r.depth for r in chain.collect()}
    for s in compute.compute_stats(chain).collect():
        mine = [r for r in rows if r[0] == s.rec]
        total = sum(r[5] for r in mine)
        limit = max(2 * (total // len(mine)), 10)
        slowest = max(mine, key=lambda r: (r[5], -r[1]))
        roots = [r[7] for r in sorted(mine) if depth[r[0], r[1]] == 0 and r[7]]
        assert (s.total_ms, s.node_count, s.bottleneck_count) == (total, len(mine), sum(r[5] >= limit for r in mine))
        assert (s.slowest_ms, s.slowest_node) == ((slowest[5], f"compute-{slowest[1]}") if slowest[5] else (0, ""))
        assert s.trigger_field == (roots[0] if roots else "")


@pytest.mark.parametrize("size", [3, 500])
def test_packed_chain_documents_equal_those_of_rows(spark, monkeypatch, size):
    """Edges, statistics and documents of short recordings come from their rows alone, without another shuffle."""
    rng = random.Random(3)
    rows = [r for i, n in enumerate([1, 2, 3, 7, 8, 9, 15, 20]) for r in random_nodes(rng, f"r{i}", n, ["a", "b", "c"])]
    rows += [(None, i, "m", "a", "c", 1, ["a"], "") for i in range(3)]  # no recording
    rows += [("odd", 0, None, "a", None, None, ["a"], None), ("odd", 1, "m", None, "x", None, [None, "a", "a"], "t"), ("odd", 2, "m", "a", "y", None, ["a", "z"], None)]
    rows += [("neg", 0, "m", "a", "y", -4, ["a"], None), ("neg", 1, "m", "b", "y", 0, ["a", "a"], "q")]

    def documents(chain):
        docs = nested.chain_documents(chain, compute.compute_edges(chain), compute.compute_stats(chain), size)
        return docs.select("rec", "chunk", *[F.to_json(c) for c in ("nodes", "edges", "summary")])

    def written_down(docs):
        return sorted(map(tuple, docs.collect()), key=str)

    frame = spark.createDataFrame(rows, NODES)
    want = written_down(documents(compute.compute_chain(frame)))
    assert any("depends" in (r[3] or "") for r in want) and any("parent" in (r[3] or "") for r in want)
    for short, longer in ((64, False), (8, True)):
        monkeypatch.setattr(compute, "SHORT", short)
        chain = compute.compute_chain(frame, packed=True)
        assert (chain.long is not None) == longer
        docs = documents(chain)
        assert written_down(docs) == want
        assert longer or "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def test_recordings_are_dealt_out_once(spark, tmp_path):
    """Ordering the lines of a recording and packing them takes one shuffle."""
    from vantage.plans.profiles import compute_nodes

    spark.createDataFrame([(1, 2, 3, 1, 4.0, 5.0, 0.0, 0.0, "R", None), (None, 2, 3, 2, 4.0, 5.0, 0.0, 0.0, "A", None)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = compute_nodes(spark, str(tmp_path))
    assert sorted((r.rec, r.idx) for r in nodes.filter("rec IS NOT NULL").collect()) == [("1", 0)]
    packed = nodes.groupBy("rec", F.floor(F.col("idx") / compute.SHORT).alias("chunk")).agg(F.collect_list("idx"))
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def events_of(frames, index, name):
    """R18 for one profile, method after method: the definition."""
    metas = {m: sorted([i[1:] for i in index if i[0] == m], key=lambda f: f[:2]) for m in {i[0] for i in index}}
    methods = sorted(f[0] for f in frames)
    owner = {f"{model}.{field}": m for m in methods for model, field, *_ in metas.get(m, ())}
    depth, parent = dict.fromkeys(methods, 0), dict.fromkeys(methods, "")
    for m in methods:
        for model, _, deps, _ in metas.get(m, ()):
            for dep in deps:
                p = owner.get(f"{model}.{dep}")
                if p and p != m and depth[m] <= depth[p]:
                    depth[m], parent[m] = depth[p] + 1, p
    roots = [".".join(metas[m][0][:2]) for m in methods if depth[m] == 0 and m in metas]
    out = []
    for m, ms, file in frames:
        trigger = ".".join(metas[parent[m]][0][:2]) if parent[m] else (roots + [""])[0]
        for model, field, deps, module in metas.get(m, [("", "", [], file.split("/")[2] if file else "")]):
            out.append((model or name, m, module, ms, field, tuple(deps), trigger, depth[m], parent[m]))
    return out


def test_profile_events_equal_the_pass_in_order(spark):
    rng = random.Random(2)
    names = [f"_compute_{c}" for c in "abcdefgh"]
    index = [(rng.choice(names[:7]), rng.choice("xy"), f"f{i}", [f"f{rng.randint(0, 19)}" for _ in range(rng.randint(0, 3))], "base")
             for i in range(20)]
    # two methods that need each other, and one that needs itself
    index += [("_compute_p", "z", "a", ["b"], "base"), ("_compute_q", "z", "b", ["a", "b"], "base")]
    frames, want = [], []
    for p in range(15):
        mine = [(m, rng.randint(1, 99), "/addons/own/a.py" if rng.random() < 0.7 else None)
                for m in rng.sample(names + ["_compute_p", "_compute_q"], rng.randint(1, 10))]
        frames += [(f"p{p}", *f) for f in mine]
        want += [(f"p{p}", *e) for e in events_of(mine, index, f"name {p}")]
    got = compute.profile_events(
        spark.createDataFrame([(f"p{p}", f"name {p}", p) for p in range(20)], "profile_id string, name string, created long"),
        spark.createDataFrame(frames, "profile_id string, method_name string, duration_ms long, source_file string"),
        spark.createDataFrame(index, "method_name string, model string, field_name string, depends_on array<string>, module string")).collect()
    assert sorted((r.profile_id, r.model, r.method, r.module, r.duration_ms, r.field_name, tuple(r.depends_on), r.trigger_field,
                   r.depth, r.parent_method) for r in got) == sorted(want)
    assert max(w[8] for w in want) >= 2 and all(r.is_compute and r.category == "profiler" and r.ts == int(r.profile_id[1:]) for r in got)
