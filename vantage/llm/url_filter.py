"""URL filter: a path-template tree with labelled purity.

1. A url is cut into host and path, the path into segments.
2. Per host the paths form a tree.  A segment is *variable* if it looks like an
   identifier (digits, with or without an ending; long hexadecimal; a date), or if
   its place in the tree (host, template so far, depth) has nearly as many
   different segments as pages.  Variable segments become ``*``; the tree is
   generalised level by level, each level one aggregate over distinct paths.
3. Sister templates (same host, depth and ending, differing in one literal
   segment) whose share of bad labels agrees with that of all sisters together
   within a Hoeffding bound are merged to one template, ``+`` in place of the literal.
4. A template's labelled pages give its share of bad ones, smoothed towards its
   host's share, and that towards the share of all; a template above ``REJECT`` is
   blocked.
5. Rules go before the templates: the longest rule that fits the url decides.

A page is labelled through ``labels`` (page_id is the doc_id of the document it
holds) and bad if one of its labels is toxic.

Results for odd input: a null url and one without ``://`` have an empty host and
path, no rule, and are judged as the template of that empty host; urls that are
repeated are judged alike; null labels are no labels; without labels everything
is allowed; other columns, the page's text among them, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.session import cut_lineage

#: (host, path, verdict); fixed values
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A place with this many pages, and this share of different segments, is variable.
VARIABLE_PAGES, VARIABLE_SHARE = 20, 0.5
#: Sisters further apart than the bound allows at this error stay apart.
MERGE_ERROR = 0.05
#: Pages that the prior counts for, and the smoothed bad share that blocks.
PRIOR_PAGES, REJECT = 10.0, 0.3
#: Parts that the pages of one template are dealt to when the verdicts are joined.
SALT = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest fitting rule, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def looks_variable(segment: Column) -> Column:
    return segment.rlike(r"^[0-9]+([-_][0-9]+)*(\.[A-Za-z0-9]{1,5})?$|^[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$")


def templates(paths: DataFrame) -> DataFrame:
    """host, path, template of every distinct (host, path, n) of ``paths``."""
    known = paths.withColumn("segments", F.split("path", "/")).withColumn("template", F.lit(""))
    deepest = known.agg(F.max(F.size("segments"))).first()[0] or 0
    for depth in range(deepest):
        own = F.get("segments", F.lit(depth))
        # what a place holds: pages and different segments, counted where segments do not look like identifiers
        at = known.filter(F.size("segments") > depth).select("host", "template", own.alias("segment"), "n")
        child = at.filter(~looks_variable(F.col("segment"))).groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
        place = (child.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.count("*").alias("different"))
                 .filter((F.col("pages") >= VARIABLE_PAGES) & (F.col("different") >= VARIABLE_SHARE * F.col("pages")))
                 .select("host", "template", F.lit(True).alias("variable")))
        part = F.when(F.size("segments") <= depth, "").otherwise(F.concat(
            F.lit("/" if depth else ""), F.when(looks_variable(own) | F.col("variable"), "*").otherwise(own)))
        known = cut_lineage(known.join(place, ["host", "template"], "left")
                            .withColumn("template", F.concat("template", part)).drop("variable"))
    return known.select("host", "path", "template")


def purity(counts: DataFrame) -> DataFrame:
    """host, template, merged, bad_share, blocked of every (host, template, labelled, bad) of ``counts``."""
    # sisters: templates of a host that differ in their first literal segment only
    family = F.regexp_replace("template", r"^(/?)[^/*]+(/|$)", "$1+$2")
    one = counts.withColumn("family", family)
    all_sisters = one.groupBy("host", "family").agg(F.sum("labelled").alias("n_all"), F.sum("bad").alias("bad_all"))
    one = one.join(all_sisters, ["host", "family"])
    bound = F.sqrt(F.lit(0.5) * F.log(F.lit(2 / MERGE_ERROR))) * (1 / F.sqrt("labelled") + 1 / F.sqrt("n_all"))
    alike = (F.col("labelled") == 0) | (F.col("n_all") == 0) | (
        F.abs(F.col("bad") / F.col("labelled") - F.col("bad_all") / F.col("n_all")) <= bound)
    one = one.withColumn("merged", F.when(alike, F.col("family")).otherwise(F.col("template")))
    group = one.groupBy("host", "merged").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("bad").alias("host_b"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_b").alias("b")).first()
    share = (total["b"] or 0) / total["n"] if total["n"] else 0.0
    host_share = (F.col("host_b") + PRIOR_PAGES * share) / (F.col("host_n") + PRIOR_PAGES)
    scored = (group.join(hosts, "host")
              .select("host", "merged", ((F.col("b") + PRIOR_PAGES * host_share) / (F.col("n") + PRIOR_PAGES)).alias("bad_share")))
    return one.select("host", "template", "merged").join(scored, ["host", "merged"])


def url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share of every row of ``pages``."""
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = (labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id")
           .agg((F.max("toxic") > 0).cast("long").alias("bad")))
    marked = cut.join(bad, cut["page_id"] == bad["doc_id"], "left").select("host", "path", "bad")
    paths = cut_lineage(marked.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    found = templates(paths.select("host", "path", "n"))
    counted = paths.join(found, ["host", "path"])
    counts = cut_lineage(counted.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    judged = found.join(purity(counts), ["host", "template"]).select(
        "host", "path", F.col("merged").alias("template"), "bad_share")
    # one row for each path, dealt to SALT parts: a path that very many pages share is no single task
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    done = salted.join(judged, ["host", "path", "salt"], "left")
    by_template = F.when(F.col("bad_share") > REJECT, "block").otherwise("allow")
    return done.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_template).alias("verdict"),
                       "template", "bad_share")
