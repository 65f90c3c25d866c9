"""URL filter: host and path rules, and a path-template tree whose branches are rejected by smoothed labelled purity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm._shared import apart, stored

#: Rules in no special order: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels of the tree; what follows is one segment, read whole. Children that a node may have before those with less than one in so
#: many of its urls become a wildcard.
DEPTH, CHILDREN = 8, 24
#: Labelled urls that a branch needs to be compared with its siblings; standard errors within which they are alike.
EVIDENCE, ERRORS = 5, 1.96
#: Smoothed share of blocked urls from which a template is rejected; urls that a level's parent counts for, and domains that the
#: share of all labels counts for.
REJECT, PRIOR, VOTES = 0.75, 2, 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for null."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (`host/path`, null if none) and its verdict; of two as long, the one first in the alphabet."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    name = reduce(lambda out, x: F.when(x[0], x[1][1] + x[1][2]).otherwise(out), reversed(list(zip(fits, ordered, strict=True))), F.lit(None).cast("string"))
    verdict = reduce(lambda out, x: F.when(x[0], x[1][0]).otherwise(out), reversed(list(zip(fits, ordered, strict=True))), F.lit(None).cast("string"))
    return name, verdict


def _shape(path: Column) -> Column:
    """A path with its plainly variable parts generalised: long mixed tokens are `*`, digits `#`."""
    return F.regexp_replace(F.regexp_replace(path, "[A-Za-z_-]*[0-9][A-Za-z0-9_-]{15,}", "*"), "[0-9]+", "#")


def domain(host: Column) -> Column:
    """The last two labels of a host without its port."""
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -2)


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, labelled, blocked, purity) of urls (host, path, label block, allow or null).

    Urls shrink to counts per host and shape first, so a host with a third of all rows is combined before it is shuffled.
    Then the tree is walked from the root, one join per level: of a node's many children those with few urls and labels become
    `*`; children with EVIDENCE labels whose blocked share lies within ERRORS standard errors of their siblings' together become
    `~`; others stay. purity: the blocked share of the host's template, smoothed towards that of its domain's, this one towards the
    mean over the domains that have EVIDENCE labels of the template, and this one towards the share of all labels.
    """
    shape = urls.select("host", _shape(F.col("path")).alias("shape"), "label")
    counted = shape.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.count(F.when(F.col("label") == "block", 1)).alias("bad"))
    tree = stored(counted.withColumn("done", F.lit("")), "url-tree")
    deepest = tree.agg(F.max(F.size(F.split("shape", "/")))).first()[0] or 0
    for level in range(1, min(deepest - 1, DEPTH) + 1):
        segments = F.split("shape", "/")
        rest = F.when(F.size(segments) > level, F.array_join(F.slice(segments, level + 1, F.greatest(F.size(segments), F.lit(1))), "/"))
        tree = tree.withColumn("seg", rest if level == DEPTH else F.get(segments, F.lit(level)))
        child = tree.filter(F.col("seg").isNotNull()).groupBy("host", "done", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "bad")))
        known = F.col("lab") >= EVIDENCE
        node = child.groupBy("host", "done").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum(F.when(known, F.col("bad"))).alias("all_bad"), F.sum(F.when(known, F.col("lab"))).alias("all_lab"))
        share = F.col("all_bad") / F.col("all_lab")
        alike = F.abs(F.col("bad") / F.col("lab") - share) <= ERRORS * F.sqrt(share * (1 - share) / F.col("lab")) + 1e-9
        rare = (F.col("kids") > CHILDREN) & (F.col("n") * CHILDREN < F.col("all_n")) & ~known
        named = child.join(apart(node), ["host", "done"]).select("host", "done", "seg", F.when(rare, "*").when(known & alike, "~").otherwise(F.col("seg")).alias("name"))
        tree = tree.join(apart(named), ["host", "done", "seg"], "left").select("host", "shape", "n", "lab", "bad", F.concat("done", F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit("/"), "name"))).alias("done"))
        tree = stored(tree, "url-tree")

    def smoothed(bad: str, lab: str, parent: Column, prior: int = PRIOR) -> Column:
        return (F.coalesce(F.col(bad), F.lit(0)) + prior * parent) / (F.coalesce(F.col(lab), F.lit(0)) + prior)

    # templates of different hosts are the same if they are written alike, the merged children of a host by what they were
    tree = tree.withColumn("domain", domain(F.col("host")))
    own = tree.groupBy("host", "done").agg(F.sum("lab").alias("labelled"), F.sum("bad").alias("blocked"))
    by_domain = tree.groupBy("domain", "shape").agg(F.sum("lab").alias("domain_lab"), F.sum("bad").alias("domain_bad"))
    votes = by_domain.filter(F.col("domain_lab") >= EVIDENCE).groupBy("shape").agg(F.count("*").alias("votes"), F.sum(F.col("domain_bad") / F.col("domain_lab")).alias("against"))
    every = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("lab"), F.lit(0)) + 2)).alias("all"))  # one row
    out = tree.select("host", "shape", "done", "domain").join(apart(own), ["host", "done"]).join(apart(by_domain), ["domain", "shape"]).join(apart(votes), "shape", "left").crossJoin(F.broadcast(every))
    anywhere = smoothed("against", "votes", F.col("all"), VOTES)
    return out.select("host", "shape", F.col("done").alias("template"), "labelled", "blocked", smoothed("blocked", "labelled", smoothed("domain_bad", "domain_lab", anywhere)).alias("purity"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, blocked, purity: a row for each input row.

    The rules label urls; a url without a rule gets its template's verdict: block if the template's smoothed purity is REJECT or
    more, else allow. Null urls and those without `://` have an empty host and path.
    """
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("label"))
    tree = templates(ruled)
    ruled = ruled.withColumn("shape", _shape(F.col("path")))
    return ruled.join(tree, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "labelled", "blocked", "purity")
