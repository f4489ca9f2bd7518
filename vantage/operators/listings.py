"""Catalog listings and nested records (T3, T5, F6, J11-J13, X4, and the closed-only rule of U4 / U6).

Positions are taken per environment with the paging helper, so a hot
environment ships at most one page per partition.  Nested lists hold
configuration (fields, access rows, rules of a model), never event rows, and are
made distinct before they are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.parsing import module_from_source
from vantage.operators.errors import OPEN, search_groups
from vantage.operators.tables import fold_status, page


def with_status(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Groups with their current status (last change by ts, seq); open without one."""
    now = fold_status(changes, ["env_id", "signature"], "status", ["ts", "seq"]).select("env_id", "signature", "status")
    return (groups.join(now, ["env_id", "signature"], "left")
            .withColumn("status", F.coalesce("status", F.lit(OPEN))))


def list_groups(groups: DataFrame, search: str = "", status: str = "", error_type: str = "",
                page_no: int = 1, per_page: int = 25) -> DataFrame:
    """One page of error groups per environment.  Only one filter applies: search
    before status before type; search and status list the last seen first, type and
    the plain list the most frequent first.  Ties go by last_seen, then signature."""
    seen = [F.col("last_seen").desc(), F.col("signature")]
    often = [F.col("occurrence_count").desc(), *seen]
    if search:
        rows, order = search_groups(groups, search), seen
    elif status:
        rows, order = groups.filter(F.col("status") == status), seen
    elif error_type:
        rows, order = groups.filter(F.col("error_type") == error_type), often
    else:
        rows, order = groups, often
    return page(rows, ["env_id"], order, page_no, per_page)


def expired_groups(groups: DataFrame, owners: DataFrame, now) -> DataFrame:
    """U4 / U6 for errors: groups that retention deletes. Only closed ones go, when last
    seen before ``now - days`` of their tenant; days <= 0 disables.  ``owners``:
    (env_id, tenant_id, days).  Their non-NULL ``raw_trace_ref`` is the orphan manifest."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.col("days"))
    return (groups.join(owners, "env_id")
            .filter((F.col("days") > 0) & (F.col("last_seen") < cutoff) & (F.col("status") != OPEN)))


def budget_catalog(budgets: DataFrame, active_only: bool = True) -> DataFrame:
    """T5: budgets in catalog order (module, endpoint) within their environment."""
    rows = budgets.filter("is_active") if active_only else budgets
    return rows.orderBy("env_id", "module", "endpoint", "budget_id")


def presence_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``flag`` = whether ``column`` has a value; the column itself is not listed."""
    return df.withColumns({flag: F.col(c).isNotNull() for flag, c in flags.items()}).drop(*flags.values())


def nest(parents: DataFrame, children: DataFrame, keys: Sequence[str], entry: Column, out_col: str) -> DataFrame:
    """The distinct ``entry`` values of each parent's children as a sorted
    list; parents without children get an empty one, children without a parent are dropped."""
    keys = list(keys)
    lists = (children.select(*keys, entry.alias("_entry")).distinct()
             .groupBy(*keys).agg(F.sort_array(F.collect_list("_entry")).alias(out_col)))
    out = parents.join(lists, keys, "left")
    return out.withColumn(out_col, F.coalesce(out_col, F.array().cast(out.schema[out_col].dataType)))


def ordered_distinct(values: Column) -> Column:
    """Distinct values in order of their first place."""
    return F.array_distinct(values)


def field_index(records: DataFrame) -> DataFrame:
    """J13, index side: computed fields by method.  Records without model, name or compute
    method are skipped; ``depends`` is split at commas, the first of ``modules`` counts."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("model", "name", "compute", "depends", "modules")}
    depends = F.filter(F.transform(F.split(text["depends"], ","), lambda d: F.trim(d)), lambda d: d != "")
    return (records.filter((text["model"] != "") & (text["name"] != "") & (text["compute"] != ""))
            .select(F.col("compute").alias("method_name"), "model", F.col("name").alias("field_name"),
                    depends.alias("depends_on"), F.trim(F.substring_index(text["modules"], ",", 1)).alias("module")))


def with_fields(frames: DataFrame, index: DataFrame) -> DataFrame:
    """One row per (frame, field) of its method; a method without fields keeps one
    row with empty model and field and the module of its source file."""
    i = index.withColumn("_found", F.lit(True))
    j = frames.join(i, "method_name", "left")
    own = module_from_source(F.col("source_file"))
    return (j.withColumn("module", F.when(F.col("_found"), F.col("module")).otherwise(F.coalesce(own, F.lit(""))))
            .withColumns({c: F.coalesce(c, F.lit("")) for c in ("model", "field_name")})
            .withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))).drop("_found"))
