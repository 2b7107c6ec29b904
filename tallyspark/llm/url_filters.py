"""URL filters: host and path rules first, then a tree of path templates per site.

The tree is learnt in a few aggregates.  Segments with digits are generalised,
and so are the rare children of a node that has too many of them.  Branches of
one node that lead to the same continuation merge where their labelled rates do
not differ significantly.  A template is rejected by its smoothed purity: the
part of its labelled pages that are bad, drawn towards the overall part.  Labels
come from what pages hold (``seeded``), never from their urls, and only teach.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: Levels of the tree; what lies deeper belongs to its last level.
DEPTH = 4
#: A node with so many children, each with so few urls on average, has a variable segment:
#: its children under RARE urls become one wildcard.
MANY_CHILDREN, FEW_URLS, RARE = 20, 5.0, 50
#: Branches whose rates differ by less than so many standard errors merge.
SIMILAR_SIGMAS = 2.5
#: Weight of the overall part of bad pages, least labelled pages, and purity from which a template is rejected.
SMOOTHING, LEAST_LABELLED, REJECT_AT = 10.0, 10, 0.5

#: Leading labels of a host that serve the same site; its pages are pooled.
SERVICES = (r"www[0-9]*", "m", "mobile", "amp", "blog")
#: Words of a page (its texts and the targets of its links) that label it as bad: gambling, drugs, sex, advertising.
SEED_WORDS = ("casino", "poker", "bet", "bets", "betting", "jackpot", "pills", "viagra", "porn", "xxx", "adult", "escort", "spam", "ads")

DIGITS, ANY, MERGED = "{n}", "{*}", "{~}"


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(verdict, host, "/" + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def site_of(host: Column) -> Column:
    """The host without leading labels like www and m, as long as two labels remain."""
    return F.regexp_replace(host, r"^(?:(?:" + "|".join(SERVICES) + r")\.)+(?=[^.]+\.)", "")


def seeded(content: Column, words: Sequence[str] = SEED_WORDS) -> Column:
    """Whether one of ``words`` stands in ``content`` as a whole word, in any case (null: null)."""
    return content.rlike(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])")


def _segments() -> Column:
    """The segments of a path, digits generalised, without slashes at its end; what lies beyond the last level is joined to it."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "/+$", ""), r"[0-9]+", DIGITS.replace("{", r"\{")), "/")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    deep = F.concat(F.slice(inner, 1, DEPTH - 1),
                    F.array(F.array_join(F.slice(inner, DEPTH, F.greatest(F.size(inner), F.lit(1))), "/")))
    return F.when(F.size(inner) > DEPTH, deep).otherwise(inner)


def _with_segment(level: int, value: Column) -> Column:
    """The segments with that of ``level`` (from 0) replaced."""
    return F.when(F.size("segments") > level, F.transform(
        "segments", lambda s, i: F.when(i == level, value).otherwise(s))).otherwise(F.col("segments"))


def learn_templates(pages: DataFrame) -> DataFrame:
    """(host, segments, template, reject, reason) for every host and generalised path of ``pages``.

    ``pages`` has ``host, path`` and ``bad`` (true, false, or null without a
    label).  Null labels count for the shape of the tree only.  ``segments`` is
    what ``_segments`` makes of a path; ``reject`` is decided per template.
    """
    bad = F.col("bad").cast("int")
    tree = written(pages.select("host", _segments().alias("segments"), bad.alias("bad"))
                   .groupBy("host", "segments")
                   .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"),
                        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                   .select("host", F.col("segments").alias("original"), "segments", "n", "labelled", "bad"), "url-tree")
    for level in range(DEPTH):
        here = tree.where(F.size("segments") > level).select(
            "host", F.slice("segments", 1, level).alias("above"), F.col("segments")[level].alias("child"), "n")
        children = here.groupBy("host", "above", "child").agg(F.sum("n").alias("urls"))
        nodes = children.groupBy("host", "above").agg(F.count("*").alias("many"), F.sum("urls").alias("total"))
        variable = (nodes.where((F.col("many") >= MANY_CHILDREN) & (F.col("total") < FEW_URLS * F.col("many")))
                    .select("host", "above", F.lit(True).alias("variable")))
        rare = (children.where(F.col("urls") < RARE).join(variable, ["host", "above"], "left_semi")
                .select("host", "above", "child", F.lit(True).alias("rare")))
        tree = (tree.withColumn("above", F.slice("segments", 1, level))
                .withColumn("child", F.when(F.size("segments") > level, F.col("segments")[level]))
                .join(rare, ["host", "above", "child"], "left")
                .withColumn("segments", F.when(F.col("rare"), _with_segment(level, F.lit(ANY)))
                            .otherwise(F.col("segments"))).drop("above", "child", "rare"))
    tree = written(tree, "url-tree")
    for level in reversed(range(DEPTH)):
        branches = (tree.where(F.size("segments") > level).groupBy("host", "segments")
                    .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
                    .withColumn("hole", _with_segment(level, F.lit(MERGED))))
        groups = branches.groupBy("host", "hole").agg(
            F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings"))
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.col("all_bad") / F.col("all_labelled")
        gap = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
        # Without labels on either side there is nothing to tell branches apart by.
        similar = F.when((F.col("labelled") == 0) | (rest == 0), True).otherwise(gap <= SIMILAR_SIGMAS * error)
        merged = (branches.join(groups.where("siblings > 1"), ["host", "hole"]).where(similar)
                  .select("host", "segments", "hole"))
        tree = (tree.join(merged, ["host", "segments"], "left")
                .withColumn("segments", F.coalesce("hole", "segments")).drop("hole"))
    tree = written(tree, "url-tree")
    overall = tree.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = overall["bad"] / overall["labelled"] if overall["labelled"] else 0.0
    purity = (F.col("bad") + SMOOTHING * prior) / (F.col("labelled") + SMOOTHING)
    verdicts = (tree.groupBy("host", "segments").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
                .select("host", "segments", ((F.col("labelled") >= LEAST_LABELLED) & (purity >= REJECT_AT)).alias("reject"),
                        F.format_string("%d of %d labelled pages are bad, smoothed purity %.3f", "bad", "labelled", purity).alias("reason")))
    return (tree.select("host", "original", "segments").join(verdicts, ["host", "segments"])
            .select("host", F.col("original").alias("segments"),
                    F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"), "reject", "reason"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], bad: Column, key: str = "page_id",
               url: str = "url") -> DataFrame:
    """``key, host, path, rule, template, verdict, reason`` of every row of ``pages``.

    ``bad`` labels rows of ``pages`` for learning (null: no label) and has no
    other part in a verdict.  Templates are learnt per site (``site_of``).  The
    longest fitting rule decides; else a rejected template blocks, and anything
    else is allowed.  ``reason`` says what the template's verdict rests on.  A
    null url, or one without ``://``, has an empty host and path, which no rule
    fits.  Repeated rows are judged each; an empty table stays empty.
    """
    labelled = pages.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{url}`").alias("__url"), bad.alias("bad"))
    parsed = labelled.withColumns({"host": split_url(F.col("__url").cast("string"))[0], "path": split_url(F.col("__url").cast("string"))[1]})
    parsed = written(parsed.select(F.col("__key").alias(key), "host", "path", site_of(F.col("host")).alias("site"), "bad"), "urls")
    templates = (learn_templates(parsed.select(F.col("site").alias("host"), "path", "bad"))
                 .withColumnRenamed("host", "site"))
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("reject"), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        rule = F.when(r.fits(), F.lit(r.text)).otherwise(rule)
        verdict = F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return (parsed.withColumn("segments", _segments()).join(templates, ["site", "segments"], "left")
            .select(F.col(f"`{key}`"), "host", "path", rule.alias("rule"), "template", verdict.alias("verdict"), "reason"))


#: The rules of the registered query.
RULES = (Rule.of("allow", "org/"), Rule.of("block", "example.org/es/"), Rule.of("block", "example.org/en/1"),
         Rule.of("allow", "com/fr/"), Rule.of("block", "com/de/"))
