"""URL filter by explicit rules and a path-template tree of each host.

Path segments become a tree under each host. Segments that look variable
(holding a digit, or very long) are generalised at once, keeping an extension.
Going down level by level, the children of a node are merged into a wildcard
where their labelled purity does not differ from that of the whole node; a
child that differs stays apart, however many siblings it has. This goes as deep
as labels can tell children apart. A template is rejected if its share of bad
labels, smoothed by that of the node above and so on up to all hosts, passes a
threshold.

All statistics are sums grouped by (host, template), pre-aggregated within
tasks; pages meet them in one equi-join, which can be split for a hot host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Standard errors by which a child must differ from its siblings to stay apart.
APART = 2.58
#: Labels' worth of trust in the node above.
WEIGHT = 8.0
#: Share of bad labels at which a template is rejected.
REJECT = 0.5

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased in A-Z) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest of ``rules`` ((verdict, host/path prefix)) that fits, and its verdict; else null.

    A rule fits its host and all subdomains if the path starts with its own.
    The rules are a parameter of bounded length: they become one expression.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, said).otherwise(verdict)
    return found, verdict


def segment(raw: Column) -> Column:
    """A path segment, generalised if it looks variable: ``7817.html`` is ``*.html``."""
    variable = raw.rlike("[0-9]") | (F.length(raw) > 40)
    return F.when(variable, F.concat(F.lit("*"), F.regexp_extract(raw, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(raw)


def templates(pages: DataFrame) -> DataFrame:
    """The tree over (host, key, labels, bad), key being the segments joined by ``/``: host, key, template and purity.

    Each round looks one level deeper into the nodes that labels can still
    split, and ends the others: what is left of their paths is ``*``, or
    ``**`` for several segments. A part with all labels of its node keeps the
    node's purity, so that no label counts more often in a deeper path.
    """
    leaves = stage(pages.groupBy("host", "key").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), "paths")
    total = leaves.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels")).first()
    overall = (total.bad + 1) / (total.labels + 2)
    sums = [F.sum("labels").alias("labels"), F.sum("bad").alias("bad")]
    smooth = lambda prior: (F.col("bad") + WEIGHT * prior) / (F.col("labels") + WEIGHT)
    hosts = leaves.groupBy("host").agg(*sums).select("host", F.col("labels").alias("all"), smooth(F.lit(overall)).alias("purity"))
    level = leaves.join(hosts, "host").withColumn("template", F.lit(""))
    done, k, node = [], 0, ["host", "template"]
    while True:
        part = F.coalesce(F.get(F.split("key", "/"), F.lit(k)), F.lit(""))
        level = level.withColumn("part", part)
        children = level.groupBy(*node, "part").agg(*sums, F.first("purity").alias("above"), F.first("all").alias("all"))
        share = F.col("bad") / F.col("labels")
        differs = (F.col("labels") > 0) & (F.abs(share - F.col("above")) > APART * F.sqrt(F.col("above") * (1 - F.col("above")) / F.col("labels")))
        own = F.when((F.col("part") == "") | differs, F.col("part")).otherwise("*")
        children = stage(children.withColumn("own", own), "children")
        merged = children.groupBy(*node, "own").agg(*sums, F.first("above").alias("above"), F.first("all").alias("all"))
        purity = F.when(F.col("labels") == F.col("all"), F.col("above")).otherwise(smooth(F.col("above")))
        merged = merged.withColumn("purity", purity)
        # The child that differs most holds all bad labels and no other, or all good ones.
        p, good = F.col("purity"), F.col("labels") - F.col("bad")
        splits = (F.col("bad") > 0) & (good > 0) & ((F.col("bad") * (1 - p) > APART**2 * p) | (good * p > APART**2 * (1 - p)))
        rated = merged.select(*node, "own", "purity", F.col("labels").alias("all"), ((F.col("own") != "") & splits).alias("open"))
        named = children.select(*node, "part", "own").join(rated, [*node, "own"])
        level = level.drop("purity", "all").join(named, [*node, "part"])
        level = level.withColumn("template", F.concat("template", F.when(F.col("own") == "", "").otherwise(F.concat(F.lit("/"), "own"))))
        level = stage(level.select(*node, "key", "labels", "bad", "all", "purity", "open"), "tree")
        k += 1
        rest = F.size(F.split("key", "/")) - k
        tail = F.when(rest <= 0, "").when(rest == 1, "/*").otherwise("/**")
        done.append(level.filter(~F.col("open")).select("host", "key", F.concat("template", tail).alias("template"), "purity"))
        level = level.filter("open").drop("open")
        if level.isEmpty():
            return reduce(DataFrame.union, done)


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url, bad).

    ``bad`` is a label: true, false, or null for none. Returns page_id, host,
    path, rule (the longest that fits, else null), verdict (``allow`` or
    ``block``: the rule's, else the template's), template and purity (the
    smoothed share of bad labels). A null URL, or one without ``://``, has an
    empty host and path and is judged as such. Repeated rows are judged alike;
    an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("bad").isNotNull().cast("int").alias("labels"), F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad"))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    cut = stage(rows.withColumn("key", F.array_join(F.transform(parts, segment), "/")), "urls")
    found = cut.join(templates(cut), ["host", "key"], "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
