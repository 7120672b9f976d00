"""URL filters: a path-template tree for each host, rejected by smoothed labelled purity.

URLs count once as distinct paths with their numbers of pages and labels; the tree grows over
these, in DataFrame operations only. At each node of the tree:

1. a segment is variable, and becomes the wildcard `*`, if it has fewer than `least` pages, or if
   it has a digit as have at least `least` different segments of the node; all others are
   branches by name, however many they are and however large the node is;
2. branches whose rate of bad labels doesn't differ from that of their labelled siblings together
   (two-sample z-test at `z`) merge into one branch `~`, if there are two such or more; a branch
   without labels, or with no labelled sibling, stays by itself;
3. the node's paths go on along their branch until their last segment.

A template (host, path of branches) is rejected if its smoothed purity
(good + weight * p) / (labelled + weight), p the share of good labels over all URLs, is under
`purity`.

A round takes all open nodes one branching further: what all paths of a node have in common is
passed in one step, a node of one path or of fewer than `least` pages ends, so rounds follow the
branchings and not the length of paths. The lineage is cut each round.

Defined results: scheme, port, query, fragment and empty segments don't matter, and hosts are
lower case; a null or unparsable URL has a null host and the template of a bare host, and is
never rejected; a page with several labels counts each, null labels count as none; repeated
rows count and stay; an empty table gives no rows; with no labels nothing is merged or rejected;
further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

LEAST, Z, WEIGHT, PURITY = 5, 1.96, 10.0, 0.6


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path: segments, each behind a slash."""
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:@]+)", 1))
    path = F.rtrim(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)$", 1), "/+", "/"), F.lit("/"))
    return pages.select("page_id", "url").select("page_id", F.when(host != "", host).alias("host"), F.coalesce(F.when(host != "", path), F.lit("")).alias("path"))


def _differs(l: Column, b: Column, pl: Column, pb: Column, z: float) -> Column:
    """A branch's rate of bad labels differs from that of its node's other branches; null without labels on either side."""
    rest, p = pl - l, pb / pl
    score = F.abs(b / l - (pb - b) / rest) / F.sqrt(p * (1 - p) * (1 / l + 1 / rest))
    return F.when((l > 0) & (rest > 0), F.when((pb == 0) | (pb == pl), F.lit(False)).otherwise(score >= z))


def _joined(segs: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s: F.concat(F.lit("/"), s)), "")


def tree(paths: DataFrame, least: int = LEAST, z: float = Z) -> DataFrame:
    """(host, path, template) for distinct (host, path, n, l, b): pages, labels and bad ones."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    open_ = cut(paths.select("host", "path", segs.alias("segs"), "n", "l", "b", F.lit("").alias("prefix")))
    done: list[DataFrame] = []
    while True:
        # segs: what a path still has to go
        node = open_.where(F.size("segs") > 0).groupBy("host", "prefix").agg(F.count("*").alias("m"), F.sum("n").alias("pn"), F.min("segs").alias("lo"), F.max("segs").alias("hi"))
        same = F.array_size(F.filter(F.transform("lo", lambda s, i: F.forall(F.transform(F.slice("lo", F.lit(1), i + 1), lambda t, k: t.eqNullSafe(F.get("hi", k))), lambda e: e)), lambda e: e))
        node = node.select("host", "prefix", "m", "pn", same.alias("common"))
        at = open_.join(node, ["host", "prefix"], "left")
        small, whole = F.col("pn") < least, (F.col("m") == 1) | (F.size("segs") == F.col("common"))
        ends = F.when(F.size("segs") == 0, F.col("prefix")).when(small, F.concat("prefix", F.repeat(F.lit("/*"), F.size("segs")))).when(whole, F.concat("prefix", _joined(F.col("segs"))))
        at = cut(at.withColumn("template", ends))
        done.append(at.where("template is not null").select("host", "path", "template"))
        go = at.where("template is null").select("host", "path", "n", "l", "b", F.concat("prefix", _joined(F.slice("segs", F.lit(1), F.col("common")))).alias("prefix"), F.get("segs", F.col("common")).alias("seg"), F.expr("slice(segs, common + 2, size(segs))").alias("segs"))
        if go.isEmpty():
            break
        child = go.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"))
        digit = F.col("seg").rlike("[0-9]")
        total = child.groupBy("host", "prefix").agg(F.sum(digit.cast("int")).alias("digits"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        named = child.join(total, ["host", "prefix"]).withColumn("name", F.when((F.col("n") < least) | digit & (F.col("digits") >= least), F.lit("*")).otherwise(F.col("seg")))
        branch = named.groupBy("host", "prefix", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("pl").alias("pl"), F.first("pb").alias("pb"))
        alike = ~F.coalesce(_differs(*map(F.col, ("l", "b", "pl", "pb")), z), F.lit(True))
        branch = branch.select("host", "prefix", "name", alike.alias("alike"))
        merged = branch.where("alike").groupBy("host", "prefix").agg(F.count("*").alias("alikes")).where("alikes > 1")
        branch = branch.join(merged, ["host", "prefix"], "left").select("host", "prefix", "name", F.when(F.col("alike") & F.col("alikes").isNotNull(), F.lit("~")).otherwise(F.col("name")).alias("to"))
        steps = named.select("host", "prefix", "seg", "name").join(branch, ["host", "prefix", "name"]).select("host", "prefix", "seg", "to")
        open_ = cut(go.join(steps, ["host", "prefix", "seg"]).select("host", "path", "segs", "n", "l", "b", F.concat("prefix", F.lit("/"), "to").alias("prefix")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def templates(pages: DataFrame, labels: DataFrame, least: int = LEAST, z: float = Z, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """A row for each page: page_id, host, template, pages and labels of the template, purity, rejected.

    labels: (page_id, good), 1 or 0.
    """
    counted = labels.where("good is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("l"), F.sum((F.col("good") == 0).cast("long")).alias("b"))
    rows = parsed(pages)
    paths = rows.where("host is not null").join(counted, "page_id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    paths = cut(paths)
    found = tree(paths, least, z)
    whole = paths.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    prior = 1 - whole.b / whole.l if whole.l else 1.0
    stats = found.join(paths, ["host", "path"]).groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("l").alias("labelled"), F.sum("b").alias("bad"))
    stats = stats.select("*", F.round((F.col("labelled") - F.col("bad") + weight * prior) / (F.col("labelled") + weight), 6).alias("purity"))
    known = found.join(stats, ["host", "template"])
    out = rows.join(known, ["host", "path"], "left")
    return out.select("page_id", "host", F.coalesce("template", F.lit("")).alias("template"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"), "purity", F.coalesce((F.col("purity") < purity) & (F.col("labelled") > 0), F.lit(False)).alias("rejected"))
