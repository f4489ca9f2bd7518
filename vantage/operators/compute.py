"""Compute chains (R17, J14, A19) and compute events of sampled profiles.

A chain's depths are longest paths over "an earlier node produces what this one
needs".  ``levels`` finds them without folding a recording in one task: a node
has depth ``r`` or more exactly if a key that it wants is produced, at an earlier
position, by a node of depth ``r - 1`` or more.  For that only the earliest such
position of each key counts, so a round is one small aggregate and two joins on
(recording, key) and (recording, position); nodes that end at a depth leave the
frontier.  Recordings of at most ``SHORT`` positions need none of that: each is packed into one
row once, and its nodes are folded there by array functions.  There are as many rounds as the deepest chain has nodes, and cycles
cannot occur, since an edge always leads to an earlier position.

A chain may stay packed (``Chain``): what is worked out for each recording, its edges and
its statistics, is then a column beside the nodes of a short one, and needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vantage.operators.listings import with_fields
from vantage.operators.windows import running_max_in_group
from vantage.session import written

#: Recordings of at most so many positions are folded as one array (the work in one is the square of its nodes).
SHORT = 64
#: Positions of a recording that are looked through in one window.
POSITIONS = 4096


class Chain(NamedTuple):
    """A compute chain, its short recordings packed: (rec, ``nodes`` in order), and the nodes of all others as rows (None: no others)."""
    short: DataFrame
    long: DataFrame | None


class Part(NamedTuple):
    """Something worked out for each recording of a ``Chain``: a column of ``short``, and rows for the others."""
    short: Column
    long: DataFrame | None


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest paths over earlier producers.

    ``nodes``, a stored table: rec, pos, key (what the node produces, NULL for nothing),
    wants (array of keys).  Returns (rec, pos, level) of the nodes of level 1 and
    more, and (rec, key, level, first): the earliest position at which a node of
    that level or more produces the key."""
    frontier = nodes.select("rec", "pos", "key", "wants")
    reached = frontier.select("rec", "pos").limit(0)
    firsts, level = None, 0
    while True:
        first = frontier.filter(F.col("key").isNotNull()).groupBy("rec", "key").agg(F.min("pos").alias("first"))
        found = first.select("rec", "key", F.lit(level).alias("level"), "first")
        firsts = found if firsts is None else firsts.unionByName(found)
        wanted = frontier.select("rec", "pos", F.explode("wants").alias("key"))
        hits = (wanted.join(first, ["rec", "key"]).filter(F.col("first") < F.col("pos"))
                .select(F.col("rec").alias("_rec"), F.col("pos").alias("_pos")))
        seen = Observation()
        deeper = frontier.join(hits, (F.col("rec") == F.col("_rec")) & (F.col("pos") == F.col("_pos")), "left_semi")
        frontier = written(deeper.observe(seen, F.count(F.lit(1)).alias("n")))
        level += 1
        if not seen.get["n"]:  # a node of level r was in r frontiers
            return reached.groupBy("rec", "pos").agg(F.count(F.lit(1)).alias("level")), firsts
        reached = reached.unionByName(frontier.select("rec", "pos"))


def _keys(model: Column, field: Column, depends_on: Column) -> tuple[Column, Column]:
    """(key that a node produces, keys that it wants)."""
    model, field = _text(model), _text(field)
    wants = F.transform(F.filter(F.coalesce(depends_on, F.array().cast("array<string>")), lambda d: d != ""),
                        lambda d: F.concat(model, F.lit("."), d))
    return F.when(field != "", F.concat(model, F.lit("."), field)), wants


def _keyed(nodes: DataFrame) -> DataFrame:
    """A chain's nodes as ``levels`` takes them."""
    key, wants = _keys(F.col("model"), F.col("field_name"), F.col("depends_on"))
    return nodes.select("rec", F.col("idx").alias("pos"), key.alias("key"), wants.alias("wants"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column) -> Column:
    """``items``: the nodes of a recording in order, as structs with pos, key, name and wants.  For each its depth, and the
    position of its parent: the latest holder of the first dependency that reaches the depth."""
    kind = "array<struct<pos:int,key:string,name:string,depth:int,chosen:string>>"

    def step(done: Column, x: Column) -> Column:
        reach = F.transform(x["wants"], lambda d: F.array_max(F.transform(F.filter(done, lambda e: e["key"] == d), lambda e: e["depth"])))
        return _let(reach, lambda reach: _let(F.array_max(reach), lambda top: F.concat(done, F.array(F.struct(
            x["pos"].alias("pos"), x["key"].alias("key"), x["name"].alias("name"), F.coalesce(top + 1, F.lit(0)).alias("depth"),
            F.when(top.isNotNull(), F.get(x["wants"], (F.array_position(reach, top) - 1).cast("int"))).alias("chosen"))))))

    def holder(done: Column, e: Column) -> Column:
        return F.array_max(F.transform(F.filter(done, lambda o: (o["name"] == e["chosen"]) & (o["pos"] <= e["pos"])), lambda o: o["pos"]))

    return _let(F.aggregate(items, F.array().cast(kind), step), lambda done: F.transform(
        done, lambda e: F.struct(e["depth"].alias("depth"), holder(done, e).alias("parent"))))


def _by_length(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rec, ``nodes``: those of a short recording in order, ``folded``: for each its depth and the position of its parent;
    the nodes of all others as rows, or None).

    A recording is packed by ``SHORT`` positions, so that no array is longer whatever the recording; one with
    more than its first array is no short one."""
    cols = [c for c in nodes.columns if c != "rec"]
    packed = written(nodes.groupBy("rec", F.floor(F.col("idx") / SHORT).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", *[c for c in cols if c != "idx"]))).alias("nodes")))
    later = packed.filter("chunk > 0").select("rec").distinct()
    long = None if later.isEmpty() else written(later)

    def item(x: Column) -> Column:
        keys = _keys(x["model"], x["field_name"], x["depends_on"])
        name = F.concat(_text(x["model"]), F.lit("."), F.when(_text(x["field_name"]) != "", x["field_name"]).otherwise(_text(x["method"])))
        return F.struct(x["idx"].alias("pos"), keys[0].alias("key"), name.alias("name"),
                        F.when(F.col("rec").isNotNull(), keys[1]).otherwise(F.array().cast("array<string>")).alias("wants"))

    short = packed if long is None else packed.join(long, "rec", "left_anti")
    short = short.select("rec", "nodes", _folded(F.transform("nodes", item)).alias("folded"))
    if long is None:
        return short, None
    return short, packed.join(long, "rec", "left_semi").select("rec", F.inline("nodes")).select("rec", *cols)


def _node_id(idx: Column) -> Column:
    return F.concat(F.lit("compute-"), idx.cast("string"))


def compute_depths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (as for ``compute_chain``) with node_id and depth, without parents."""
    node_id = _node_id(F.col("idx"))
    short, long = _by_length(nodes)
    short = (short.select("rec", F.explode(F.arrays_zip("nodes", "folded")).alias("n")).select("rec", "n.nodes.*", F.col("n.folded.depth").alias("depth"))
             .withColumn("node_id", node_id).select(*nodes.columns, "depth", "node_id"))
    if long is None:
        return short
    long = written(long)
    depth, _ = levels(_keyed(long))
    deep = (long.join(depth.withColumnRenamed("pos", "idx"), ["rec", "idx"], "left")
            .withColumn("depth", F.coalesce("level", F.lit(0)).cast("int")).drop("level").withColumn("node_id", node_id))
    return short.unionByName(deep)


def compute_chain(nodes: DataFrame, packed: bool = False) -> DataFrame | Chain:
    """Depth and parent of each compute node.  ``nodes``: rec, idx (0-based time order), model,
    field_name, method, duration_ms, depends_on, trigger_field.

    Depth is one more than the deepest earlier node of the same model that
    produces a dependency, 0 without one.  The parent is the latest node so far
    under the name (field, else method) of the first dependency that reaches
    that depth; empty without one.  ``packed``: as a ``Chain``, else its nodes as rows."""
    cols = ["rec", "idx", "model", "field_name", "method", "duration_ms", "depends_on", "trigger_field"]
    short, long = _by_length(nodes.select(*cols))

    def done(idx: Column, rest: Callable[[str], Column], depth: Column, parent: Column) -> list[Column]:
        return [idx.alias("idx"), _node_id(idx).alias("node_id"), *[rest(c).alias(c) for c in cols[2:]], depth.alias("depth"),
                F.coalesce(_node_id(parent), F.lit("")).alias("parent_id")]

    short = short.select("rec", F.zip_with("nodes", "folded", lambda n, f: F.struct(
        *done(n["idx"], lambda c: n[c], f["depth"], f["parent"]))).alias("nodes"))
    if not packed:
        short = short.select("rec", F.inline("nodes"))
    if long is None:
        return Chain(short, None) if packed else short
    nodes = written(long)
    keyed = _keyed(nodes)
    depth, firsts = levels(keyed)
    depth = written(depth)
    # the first dependency that a node one level less deep produces earlier
    asked = (keyed.join(depth, ["rec", "pos"]).select("rec", "pos", "level", F.posexplode("wants").alias("at", "key")))
    below = firsts.select("rec", "key", (F.col("level") + 1).alias("level"), "first")
    chosen = (asked.join(below, ["rec", "key", "level"]).filter(F.col("first") < F.col("pos"))
              .groupBy("rec", "pos").agg(F.min_by("key", "at").alias("key")))
    # its latest holder: the running maximum of the positions under that name
    field = _text("field_name")
    name = F.concat(_text("model"), F.lit("."), F.when(field != "", field).otherwise(_text("method")))
    held = nodes.select("rec", name.alias("key"), F.col("idx").alias("pos"), F.lit(0).alias("kind"), F.col("idx").alias("holder"))
    looked = chosen.select("rec", "key", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("holder"))
    latest = running_max_in_group(held.unionByName(looked), ["rec", "key"], ["pos", "kind"], "holder",
                                  ts_col="pos", bucket=POSITIONS, out_col="parent")
    parent = latest.filter("kind = 1").select("rec", F.col("pos").alias("idx"), "parent")
    deep = nodes.join(depth.withColumnRenamed("pos", "idx"), ["rec", "idx"], "left").join(parent, ["rec", "idx"], "left")
    deep = deep.select("rec", *done(F.col("idx"), F.col, F.coalesce("level", F.lit(0)).cast("int"), F.col("parent")))
    return Chain(short, written(deep)) if packed else short.unionByName(deep)


def _edges_in(nodes: Column) -> Column:
    """``compute_edges`` of one recording, from its nodes."""
    def edge(kind: str, src: Column, dst: Column, field: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), field.alias("trigger_field"))

    def needed(n: Column) -> Column:
        def holder(dep: Column) -> Column:
            same = F.filter(nodes, lambda o: (o["model"] == n["model"]) & (o["field_name"] == dep))
            return F.array_max(F.transform(same, lambda o: F.struct(o["idx"], o["node_id"].alias("node_id"))))["node_id"]

        found = F.transform(n["depends_on"], lambda dep: edge("depends", holder(dep), n["node_id"], dep))
        return F.coalesce(F.filter(found, lambda e: e["src"] != e["dst"]), F.array().cast(kind))

    kind = "array<struct<kind:string,src:string,dst:string,trigger_field:string>>"
    parents = F.transform(F.filter(nodes, lambda n: n["parent_id"] != ""),
                          lambda n: edge("parent", n["parent_id"], n["node_id"], _text(n["trigger_field"])))
    both = F.concat(parents, F.flatten(F.transform(nodes, needed)))
    return F.when(F.col("rec").isNotNull(), both).otherwise(F.array().cast(kind))


def compute_edges(chain: DataFrame | Chain) -> DataFrame | Part:
    """Parent edges (parent -> node, trigger field) plus dependency edges:
    each dependency resolved against the recording's final field index
    (last node per model.field), self excluded."""
    if isinstance(chain, Chain):
        return Part(_edges_in(F.col("nodes")), None if chain.long is None else compute_edges(chain.long))
    parent = chain.filter(F.col("parent_id") != "").select(
        "rec", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"),
        _text("trigger_field").alias("trigger_field"), F.lit("parent").alias("kind"))
    idx = (chain.groupBy("rec", "model", "field_name")
           .agg(F.max_by("node_id", "idx").alias("src")))
    deps = chain.select("rec", "model", "node_id", F.explode("depends_on").alias("dep"))
    dep_edges = (deps.join(idx, (deps.rec == idx.rec) & (deps.model == idx.model) & (deps.dep == idx.field_name))
                 .filter(F.col("src") != F.col("node_id"))
                 .select(deps.rec, "src", F.col("node_id").alias("dst"), F.col("dep").alias("trigger_field"),
                         F.lit("depends").alias("kind")))
    return parent.unionByName(dep_edges)


def _stats_in(nodes: Column) -> Column:
    """``compute_stats`` of one recording, from its nodes."""
    def summed(total: Column, n: Column) -> Column:
        ms = n["duration_ms"].cast("long")
        return F.coalesce(total + ms, total, ms)

    def told(total: Column) -> Column:
        limit = F.greatest(F.floor(total / F.size(nodes)) * 2, F.lit(10))
        slowest = F.array_max(F.transform(nodes, lambda n: F.struct(n["duration_ms"].alias("ms"), (-n["idx"]).alias("neg"))))
        roots = F.filter(nodes, lambda n: (n["depth"] == 0) & (_text(n["trigger_field"]) != ""))
        trigger = F.array_min(F.transform(roots, lambda n: F.struct(n["idx"], n["trigger_field"].alias("field"))))["field"]
        return F.struct(
            total.alias("total_ms"), F.size(nodes).cast("long").alias("node_count"), F.array_max(F.transform(nodes, lambda n: n["depth"])).alias("max_depth"),
            F.when(slowest["ms"] > 0, _node_id(-slowest["neg"])).otherwise("").alias("slowest_node"),
            F.greatest(slowest["ms"], F.lit(0)).alias("slowest_ms"), F.coalesce(trigger, F.lit("")).alias("trigger_field"),
            F.size(F.filter(nodes, lambda n: n["duration_ms"] >= limit)).cast("long").alias("bottleneck_count"))

    return _let(F.aggregate(nodes, F.lit(None).cast("long"), summed), told)


def compute_stats(chain: DataFrame | Chain) -> DataFrame | Part:
    """Per recording total ms, node count, max depth, bottlenecks
    (ms >= max(2 * (sum div n), 10)), slowest node (first on ties) and the
    trigger field of the first depth-0 node that has one.

    Durations are first counted per recording and value, so the threshold, which needs
    the recording's totals, is compared with distinct durations only."""
    if isinstance(chain, Chain):
        return Part(_stats_in(F.col("nodes")), None if chain.long is None else compute_stats(chain.long))
    ms = F.col("duration_ms").cast("long")
    counted = chain.groupBy("rec", "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.min("idx").alias("first"),
        F.min(F.when((F.col("depth") == 0) & (_text("trigger_field") != ""), F.struct("idx", "trigger_field"))).alias("trigger"))
    totals = counted.groupBy("rec").agg(
        F.sum(ms * F.col("n")).alias("total_ms"), F.sum("n").alias("node_count"), F.max("depth").alias("max_depth"),
        F.max(F.struct("duration_ms", (-F.col("first")).alias("neg"))).alias("slowest"), F.min("trigger").alias("trigger"),
        F.collect_list(F.struct("duration_ms", "n")).alias("durations"))
    limit = F.greatest(F.floor(F.col("total_ms") / F.col("node_count")) * 2, F.lit(10))
    slowest = F.col("slowest.duration_ms") > 0
    return totals.select(
        "rec", "total_ms", "node_count", "max_depth",
        F.when(slowest, F.concat(F.lit("compute-"), (-F.col("slowest.neg")).cast("string"))).otherwise("").alias("slowest_node"),
        F.greatest("slowest.duration_ms", F.lit(0)).alias("slowest_ms"),
        F.coalesce("trigger.trigger_field", F.lit("")).alias("trigger_field"),
        F.aggregate("durations", F.lit(0).cast("long"), lambda a, d: a + F.when(d["duration_ms"] >= limit, d["n"]).otherwise(0))
        .alias("bottleneck_count"))


def profile_events(profiles: DataFrame, frames: DataFrame, index: DataFrame) -> DataFrame:
    """One compute event for each (profile, method, field of the method).

    ``profiles``: profile_id, name, created; ``frames``: profile_id, method_name, duration_ms,
    source_file (A20); ``index``: method_name, model, field_name, depends_on, module (J13).

    Methods of a profile are taken in order of their names, fields of a method in
    order of (model, field).  A dependency leads to the method of the same profile
    that computes it.  Depth: 1 + the largest depth of such methods, where one that
    comes later counts 0; the parent is the first that reaches it.  The
    trigger field is the parent's first field, or else the first field of the
    profile's first method of depth 0.  A method without fields has one event under the
    profile's name.  Methods that depend on each other end at the order of names."""
    frames = written(frames)  # read four times below
    named = frames.select("profile_id", "method_name").join(
        index.select("method_name", "model", "field_name", "depends_on"), "method_name")
    owner = (named.groupBy("profile_id", F.concat_ws(".", "model", "field_name").alias("need"))
             .agg(F.max("method_name").alias("source")))
    needs = named.select("profile_id", "method_name", "model", "field_name", F.posexplode("depends_on").alias("at", "dep"))
    edges = written(needs.withColumn("need", F.concat_ws(".", "model", "dep")).join(owner, ["profile_id", "need"])
                    .filter(F.col("source") != F.col("method_name"))
                    .groupBy("profile_id", "method_name", "source").agg(F.min(F.struct("model", "field_name", "at")).alias("place")))
    nodes = written(edges.groupBy("profile_id", "method_name").agg(F.collect_set("source").alias("wants"))
                    .select(F.col("profile_id").alias("rec"), F.col("method_name").alias("pos"), F.col("method_name").alias("key"), "wants"))
    deeper, _ = levels(nodes)
    depth = written(nodes.select("rec", "pos").join(deeper, ["rec", "pos"], "left")
                    .select(F.col("rec").alias("profile_id"), F.col("pos").alias("method_name"),
                            (F.coalesce("level", F.lit(0)) + 1).alias("depth")))
    source = depth.select("profile_id", F.col("method_name").alias("source"), F.col("depth").alias("source_depth"))
    passed = F.when(F.col("source") < F.col("method_name"), F.coalesce("source_depth", F.lit(0))).otherwise(0)
    parent = (edges.join(source, ["profile_id", "source"], "left")
              .groupBy("profile_id", "method_name").agg(F.min_by("source", F.struct((-passed).alias("d"), "place")).alias("parent_method")))
    first = index.groupBy("method_name").agg(F.min(F.struct("model", "field_name")).alias("f")).select(
        "method_name", F.concat_ws(".", "f.model", "f.field_name").alias("first_field"))
    roots = (frames.select("profile_id", "method_name").join(depth, ["profile_id", "method_name"], "left_anti").join(first, "method_name")
             .groupBy("profile_id").agg(F.min_by("first_field", "method_name").alias("root_field")))
    return (with_fields(frames, index).join(profiles, "profile_id")
            .join(depth, ["profile_id", "method_name"], "left").join(parent, ["profile_id", "method_name"], "left")
            .join(first.select(F.col("method_name").alias("parent_method"), F.col("first_field").alias("parent_field")), "parent_method", "left")
            .join(roots, "profile_id", "left")
            .select("profile_id", F.lit("profiler").alias("category"),
                    F.when(F.col("model") == "", F.col("name")).otherwise(F.col("model")).alias("model"),
                    F.col("method_name").alias("method"), "module", "duration_ms", F.lit(True).alias("is_compute"), "field_name", "depends_on",
                    F.coalesce("parent_field", "root_field", F.lit("")).alias("trigger_field"),
                    F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("parent_method", F.lit("")).alias("parent_method"),
                    F.col("created").alias("ts")))
