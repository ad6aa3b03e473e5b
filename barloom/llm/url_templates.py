"""URL filter by path templates of each host, learned from labelled urls.

The tree of a host grows level by level over all its paths. At a node (host, template so far) the next segment stays literal where it has
a share of the node's paths (and more than one); of the rest, shapes (digits as #) that have such a share stay as shapes,
and what is left is the wildcard ?. So a node has a bounded number of children, whatever the number of its paths. A path's end is a child of its own.

From the leaves up, sibling branches whose labels don't differ statistically become one: those with enough labelled paths are sorted by
their share of bad ones and merged while a two-proportion test finds no difference; branches with some labels, but too few, are one
group, and those without any another (what is known of others must not condemn them). A node whose children all fell into one group is one branch for its own siblings; other groups stand for themselves.

A group is rejected if its share of bad labels, smoothed by the share of the whole table, reaches a threshold with enough labelled paths.
Labels are the verdicts of the rules unless others are given: what rules say of some paths of a template is carried over to the rest of it.

All steps are joins and aggregations of urls or nodes; the driver only learns the deepest level's number and the whole table's share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, stage

#: Tokens that no segment can be: paths have no ?.
END, WILD = "??", "?"


@dataclass(frozen=True)
class Settings:
    share: float = 0.02  # of a node's paths that a literal or a shape has, at least
    levels: int = 8  # segments that the tree tells apart; what follows them is one segment
    least: int = 20  # labelled paths that a decision or a test needs
    z: float = 2.58  # two proportions further apart than this many standard errors differ
    prior: float = 10.0  # weight of the whole table's share of bad labels, in paths
    reject: float = 0.9  # smoothed share of bad labels from which on a group is rejected


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path; of equal ones the longest host) that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, settings: Settings | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), template, labelled, purity.

    A rule (host, path, verdict; a list short enough to stand in a plan) fits its host and subdomains if the path starts with its path; the longest wins and is
    shown as host + path. Pages without a rule get the verdict of their template's group; labelled counts its labelled paths and purity is the
    smoothed share of bad ones. labels (url, bad boolean) replaces the rules' verdicts as what is learned from. Paths count once by host and path, however many
    rows have them; of a path with different labels each counts. Null urls and urls without :// have an empty host and path, which is a path as any other; an empty path and / are one in the tree. Long urls
    are read whole; other columns of pages are not read, whatever their names; an empty table gives no rows.
    """
    s = settings or Settings()
    host, path = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    told = rule_of(F.col("host"), F.col("path"), rules)
    paths = rows.select("host", "path").distinct()
    if labels is None:
        verdict = told["verdict"]
        paths = paths.select("host", "path", F.when(verdict.isNotNull(), 1).otherwise(0).cast("long").alias("lab"), F.when(verdict == "block", 1).otherwise(0).cast("long").alias("bad"))
    else:
        h, p = parts(F.col("url"))
        known = labels.where("bad is not null").select(h.alias("host"), p.alias("path"), F.col("bad").cast("long").alias("bad")).distinct()
        known = known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("lab"), F.sum("bad").alias("bad"))
        paths = paths.join(known, ["host", "path"], "left").select("host", "path", F.coalesce("lab", F.lit(0)).cast("long").alias("lab"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    leaves = template_tree(paths, s)
    groups = merge_branches(leaves.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")), s)
    judged = leaves.select("host", "path", "template").join(groups, ["host", "template"])
    judged = stage(judged.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "template", "labelled", "purity", "rejected"), "judged")
    out = rows.join(judged, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")))
    learned = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn("told", told)
    return out.select(
        "page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce(F.col("told.verdict"), learned).alias("verdict"), F.concat(F.lit("/"), F.array_join(F.slice("template", 1, F.size("template") - 1), "/")).alias("template"), "labelled", "purity"
    )


def template_tree(paths: DataFrame, s: Settings) -> DataFrame:
    """paths (host, path, and other columns) with template, an array of tokens that ends in END."""
    bare = F.regexp_replace("path", "^/", "")
    # a limit of levels leaves what follows the last one told apart in one segment
    rows = paths.withColumn("segments", F.concat(F.split(bare, "/", s.levels), F.array(F.lit(END)))).withColumn("template", F.array().cast("array<string>"))
    rows = stage(rows, "paths")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        here = rows.withColumn("seg", F.get("segments", F.lit(level))).withColumn("shape", F.regexp_replace("seg", "[0-9]+", "#"))
        on = here.where("seg is not null").groupBy("host", "template", "seg", "shape").agg(F.count(F.lit(1)).alias("n"))
        on = stage(on, "segments")
        need = on.groupBy("host", "template").agg(F.greatest(F.lit(2.0), F.sum("n") * s.share).alias("need"))
        sized = on.join(need, ["host", "template"])
        literal = sized.where((F.col("n") >= F.col("need")) | (F.col("seg") == END)).select("host", "template", "seg", F.col("seg").alias("as_is"))
        shapes = sized.where((F.col("n") < F.col("need")) & (F.col("seg") != END)).groupBy("host", "template", "shape").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        shapes = shapes.where(F.col("n") >= F.col("need")).select("host", "template", "shape", F.col("shape").alias("as_shape"))
        named = here.join(literal, ["host", "template", "seg"], "left").join(shapes, ["host", "template", "shape"], "left")
        token = F.when(F.col("seg").isNotNull(), F.array(F.coalesce("as_is", "as_shape", F.lit(WILD)))).otherwise(F.array().cast("array<string>"))
        rows = stage(named.select(*paths.columns, "segments", F.concat("template", token).alias("template")), "level")
    return rows.select(*paths.columns, "template")


def merge_branches(leaves: DataFrame, s: Settings) -> DataFrame:
    """leaves: host, template, lab, bad. Adds the group's labelled, purity and rejected to host and template."""
    base = leaves.agg(F.sum("bad") / F.nullif(F.sum("lab"), F.lit(0))).first()[0] or 0.0
    # a branch: its place in the tree, its leaves' group (a template that stands for it) and its labels
    nodes = stage(leaves.select("host", "template", F.col("template").alias("place"), "lab", "bad", F.lit(True).alias("open")), "branches")
    deepest = nodes.agg(F.max(F.size("place"))).first()[0] or 0
    members = nodes.select("host", "template", F.col("template").alias("group"))
    for level in range(deepest, 0, -1):
        parent = F.slice("place", 1, level - 1)
        at = nodes.where(F.col("open") & (F.size("place") == level)).withColumn("parent", parent)
        # closed groups below keep a parent from being one branch
        shut = nodes.where(~F.col("open")).select("host", F.slice("place", 1, level - 1).alias("parent")).where(F.size("parent") == level - 1).distinct().withColumn("has_shut", F.lit(True))
        # a node has a bounded number of children: at most 2 / share + 2
        lists = at.groupBy("host", "parent").agg(F.sort_array(F.collect_list(F.struct((F.col("bad") / F.nullif(F.col("lab"), F.lit(0))).alias("rate"), F.col("template").alias("template"), "lab", "bad"))).alias("them"))
        merged = lists.withColumn("groups", _merged(F.col("them"), s)).join(shut, ["host", "parent"], "left")
        one = F.col("has_shut").isNull() & (F.size("groups") == 1)
        grown = merged.select("host", "parent", one.alias("open"), F.explode("groups").alias("g"))
        grown = stage(grown.select("host", "parent", "open", "g.lab", "g.bad", "g.of"), "merged")
        renamed = grown.select("host", F.explode("of").alias("group"), F.get("of", F.lit(0)).alias("new"))
        members = members.join(renamed, ["host", "group"], "left").select("host", "template", F.coalesce("new", "group").alias("group"))
        up = grown.select("host", F.get("of", F.lit(0)).alias("template"), F.when(F.col("open"), F.col("parent")).otherwise(F.concat("parent", F.array(F.lit("")))).alias("place"), "lab", "bad", "open")
        nodes = stage(up.unionByName(nodes.where(~F.col("open") | (F.size("place") != level)).select(*up.columns)), "branches")
        members = stage(members, "members")
    labels = nodes.select("host", F.col("template").alias("group"), F.col("lab").alias("labelled"), "bad")
    judged = labels.withColumn("purity", (F.col("bad") + s.prior * base) / (F.col("labelled") + s.prior))
    judged = judged.withColumn("rejected", (F.col("labelled") >= s.least) & (F.col("purity") >= s.reject))
    return members.join(judged, ["host", "group"]).select("host", "template", "labelled", "purity", "rejected")


def _merged(them: Column, s: Settings) -> Column:
    """Groups (lab, bad, of: templates) of sibling branches (sorted by rate): neighbours with enough labels merge unless their shares
    differ; those with fewer, and those with none, are one group each."""
    kind = "struct<lab:long,bad:long,of:array<array<string>>>"
    single = lambda x: F.struct(x["lab"].alias("lab"), x["bad"].alias("bad"), F.array(x["template"]).alias("of"))

    def add(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        pooled = (last["bad"] + x["bad"]) / (last["lab"] + x["lab"])
        apart = x["bad"] / x["lab"] - last["bad"] / last["lab"]
        error = F.sqrt(pooled * (1 - pooled) * (1 / last["lab"] + 1 / x["lab"]))
        both = F.struct((last["lab"] + x["lab"]).alias("lab"), (last["bad"] + x["bad"]).alias("bad"), F.concat(last["of"], F.array(x["template"])).alias("of"))
        alike = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(both))
        return F.when(F.size(groups) == 0, F.array(single(x))).when(F.abs(apart) <= s.z * error, alike).otherwise(F.concat(groups, F.array(single(x))))

    tested = F.aggregate(F.filter(them, lambda x: x["lab"] >= s.least), F.array().cast(f"array<{kind}>"), lambda g, x: add(g, x).cast(f"array<{kind}>"))
    nothing = F.array().cast(f"array<{kind}>")

    def pooled(some: Column) -> Column:
        total = lambda c: F.aggregate(some, F.lit(0).cast("long"), lambda n, x: n + x[c])
        one = F.struct(total("lab").alias("lab"), total("bad").alias("bad"), F.transform(some, lambda x: x["template"]).alias("of")).cast(kind)
        return F.when(F.size(some) > 0, F.array(one)).otherwise(nothing)

    few = F.filter(them, lambda x: (x["lab"] < s.least) & (x["lab"] > 0))
    return F.concat(tested, pooled(few), pooled(F.filter(them, lambda x: x["lab"] == 0)))
