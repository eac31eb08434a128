"""URL filter: listed rules first, then a path-template tree for each host.

Rules (action, host, path) fit a host and its subdomains and paths that start with theirs; the
longest wins. Pages that rules judge are the labelled ones. For the others, each host has a
tree of path templates: digit runs in a segment become `#`, a segment with fewer than
`least_pages` pages becomes `*`, and sibling branches whose labelled shares don't differ
significantly are pooled. A branch's share of blocked pages is smoothed towards its parent's, and
so on up to the host and all pages; a template is rejected where that purity reaches `limit`.

The tree is built level by level from counts per distinct template, never from pages. A node
may have any number of children: sums over siblings are partial sums that are joined back.

A null url, or one without `://`, has an empty host and path; it meets no rule and is judged
like the other pages without a host. Null page ids and repeated rows stay as they are. Empty
tables give no rows. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import ascii_lower, written


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    levels: int = 6  # what follows the sixth segment counts as one more segment
    least_pages: int = 5  # of a literal segment
    z: float = 1.96  # branches that differ less are pooled
    prior_pages: float = 4.0  # weight of the parent's purity
    limit: float = 0.8  # purity from which a template is rejected


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as defined above."""
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits the columns host and path, else null."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & (
            F.col("path").startswith(rule.path)
        )
        text = F.when(fits, rule.text).otherwise(text)
        action = F.when(fits, rule.action).otherwise(action)
    return text, action


def template_segments(path: Column, levels: int) -> Column:
    """Segments of a path with digit runs replaced; those after `levels` as one."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    head = F.slice(parts, 1, levels)
    rest = F.array_join(F.slice(parts, levels + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) > levels, F.array_append(head, rest)).otherwise(parts)


def parse(pages: DataFrame, rules: list[Rule], levels: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    text, action = matching_rule(rules)
    return (
        pages.select("page_id", "url")
        .select("page_id", host.alias("host"), path.alias("path"))
        .select("*", text.alias("rule"), action.alias("action"))
        .withColumn("segments", template_segments(F.col("path"), levels))
    )


def _smooth(bad: Column, labelled: Column, parent: Column, weight: float) -> Column:
    return (bad + weight * parent) / (labelled + weight)


def template_purity(parsed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, segments, template and purity of every distinct template path."""
    bad = F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("bad")
    labelled = F.count("action").alias("labelled")
    counted = written(
        parsed.groupBy("host", "segments").agg(F.count("*").alias("pages"), bad, labelled),
        "url-templates",
    )
    sums = [F.sum(name).alias(name) for name in ("pages", "bad", "labelled")]
    top = counted.agg(F.max(F.size("segments")).alias("depth"), *sums[1:]).first()
    everywhere = (top.bad or 0) / top.labelled if top.labelled else 0.0
    hosts = counted.groupBy("host").agg(*sums[1:])
    purity = _smooth(
        F.col("bad"), F.col("labelled"), F.lit(everywhere), settings.prior_pages
    ).alias("purity")
    tree = counted.join(hosts.select("host", purity), "host").withColumn("template", F.lit(""))
    for level in range(top.depth or 0):
        tree = _grow(written(tree, "url-tree"), level, sums, settings)
    return tree.select("host", "segments", "template", "purity")


def _grow(tree: DataFrame, level: int, sums: list[Column], settings: Settings) -> DataFrame:
    """Adds one level: the template and purity of rows that have a segment there."""
    deeper = F.size("segments") > level
    node = ["host", "template", "purity"]
    segment = F.get("segments", F.lit(level)).alias("segment")
    raw = tree.where(deeper).groupBy(*node, segment).agg(*sums)
    literal = F.col("pages") >= settings.least_pages
    named = written(
        raw.withColumn("child", F.when(literal, F.col("segment")).otherwise(F.lit("*"))), "url-named"
    )
    branches = named.groupBy(*node, "child").agg(*sums)
    siblings = ["host", "template"]
    every = branches.groupBy(*siblings).agg(
        F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled")
    )
    # Without labels on one side the divisions give null: not different.
    others = F.col("all_labelled") - F.col("labelled")
    share = F.try_divide("bad", "labelled")
    rest = F.try_divide(F.col("all_bad") - F.col("bad"), others)
    pooled = F.try_divide("all_bad", "all_labelled")
    spread = F.sqrt(
        pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), others))
    )
    different = F.coalesce(F.abs(share - rest) > settings.z * spread, F.lit(False))
    same = [
        F.sum(F.when(F.col("different"), 0).otherwise(F.col(name))).alias(f"same_{name}")
        for name in ("bad", "labelled")
    ]
    tested = written(branches.join(every, siblings).withColumn("different", different), "url-tested")
    judged = tested.join(tested.groupBy(*siblings).agg(*same), siblings)
    used = lambda name: F.when(F.col("different"), F.col(name)).otherwise(F.col(f"same_{name}"))
    grown = judged.select(
        "host", "template", "child",
        _smooth(used("bad"), used("labelled"), F.col("purity"), settings.prior_pages).alias("own"),
    )
    found = (
        named.select("host", "template", "segment", "child")
        .join(grown, ["host", "template", "child"])
        .select("host", "template", "segment", "child", "own")
    )
    return (
        tree.withColumn("segment", segment)
        .join(found, ["host", "template", "segment"], "left")
        .select(
            "host", "segments", "pages", "bad", "labelled",
            F.coalesce("own", "purity").alias("purity"),
            F.when(F.col("child").isNull(), F.col("template"))
            .otherwise(F.concat_ws("/", "template", "child"))
            .alias("template"),
        )
    )


def judge(pages: DataFrame, rules: list[Rule], settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    parsed = parse(pages, rules, settings.levels)
    tree = template_purity(parsed, settings)
    by_tree = F.when(F.col("purity") >= settings.limit, "block").otherwise("allow")
    return parsed.join(tree, ["host", "segments"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", by_tree).alias("verdict"),
        "template", "purity",
    )
