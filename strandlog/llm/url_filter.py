"""URL filters: a path-template tree per host, in DataFrame functions only.

Each host's paths form a tree of segments, built level by level. Segments that look generated (numbers, hex, dates)
become wildcards, and so do the segments of a place in the tree (below wildcards as well) that takes many different
values. Sibling branches that differ in their last
literal segment merge where their shares of blocked URLs are statistically alike. The URLs that a rule decides are the
labels: a template's purity is its share of blocked ones, smoothed towards its family's, that towards its host's and that
towards the overall share, so a branch without labels takes the purity of the nearest level that has some.
A URL that no rule fits is blocked if its template has a purity of REJECT_FROM or more.

Rows are counted by (host, path) before anything is shuffled or joined, so a host or URL that repeats costs one row.

Defined results: a null URL or one without "://" has an empty host and path; an empty path fits no rule whose path is "/".
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept

# The rules, as (action, host and path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A place in the tree with more distinct segments than this is a wildcard if they are also a good part of its URLs.
MANY_VALUES, MANY_SHARE = 12, 0.05
#: Branches whose shares lie within so many standard errors of their siblings' merge.
ALIKE = 2.0
#: Weight of the level above in a purity, in URLs.
PRIOR = 4.0
REJECT_FROM = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(action, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    """A wildcard for a segment that looks generated, else null."""
    return (
        F.when(segment.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{date}")
        .when(segment.rlike(r"^\d+$"), "{n}")
        .when(segment.rlike(r"^\d+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.(\w+)$", 1)))
        .when(segment.rlike(r"^[0-9a-fA-F]{8,}$"), "{hex}")
        .when(segment.rlike(r"\d{3,}"), "{id}")
    )


def templates(urls: DataFrame) -> DataFrame:
    """urls: host, path, n, blocked, allowed (counts), one row for each host and path. Adds tokens."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    names, none = urls.columns, F.array().cast("array<string>")
    rest = kept(urls.select(*names, F.transform(segments, lambda s: F.struct(s.alias("s"), _shape(s).alias("w"))).alias("parts"), none.alias("tokens")))
    done, i = [], 0
    # where no more paths go on than MANY_VALUES, no deeper place takes more values
    while rest.where(F.size("parts") > i).limit(MANY_VALUES + 1).count() > MANY_VALUES:
        part = F.col("parts")[i]
        here = rest.where(F.size("parts") > i).withColumns({"above": F.array_join("tokens", "/"), "s": part["s"], "w": part["w"]})
        values = here.where(F.col("w").isNull()).groupBy("host", "above", "s").agg(F.sum("n").alias("n"))
        wild = values.groupBy("host", "above").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
        wild = wild.where((F.col("kinds") > MANY_VALUES) & (F.col("kinds") > MANY_SHARE * F.col("n"))).select("host", "above", F.lit(True).alias("many"))
        token = F.coalesce("w", F.when(F.col("many"), F.lit("*")), "s")
        done.append(rest.where(F.size("parts") <= i).select(*names, "tokens"))
        rest = kept(here.join(wild, ["host", "above"], "left").select(*names, "parts", F.concat("tokens", F.array(token)).alias("tokens")))
        i += 1
    left = F.transform(F.slice("parts", i + 1, F.size("parts") + 1), lambda p: F.coalesce(p["w"], p["s"]))
    out = rest.select(*names, F.concat("tokens", left).alias("tokens"))
    for part in done:
        out = out.unionByName(part)
    return out


def _is_wild(token: Column) -> Column:
    return token.startswith("{") | (token == "*")


def judge_templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity, labels) for the rows of templates()."""
    tree = kept(templates(urls))
    last = F.array_max(F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda i: F.when((i < F.size("tokens")) & ~_is_wild(F.get("tokens", i)), i)))
    path = lambda tokens: F.concat(F.lit("/"), F.array_join(tokens, "/"))
    tree = tree.withColumn("last", last).withColumn("own", path(F.col("tokens")))
    tree = tree.withColumn("family", path(F.transform("tokens", lambda t, i: F.when(i == F.col("last"), F.lit("*")).otherwise(t))))
    sums = [F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")]
    own = tree.groupBy("host", "family", "own").agg(*sums)
    family = own.groupBy("host", "family").agg(F.sum("blocked").alias("family_blocked"), F.sum("allowed").alias("family_allowed"))
    marked, all_marked = F.col("blocked") + F.col("allowed"), F.col("family_blocked") + F.col("family_allowed")
    share, all_share = (F.col("blocked") + 0.5) / (marked + 1), (F.col("family_blocked") + 0.5) / (all_marked + 1)
    alike = F.abs(share - all_share) <= ALIKE * F.sqrt(all_share * (1 - all_share) * (1 / (marked + 1) + 1 / (all_marked + 1)))
    merged = own.join(family, ["host", "family"]).withColumn("template", F.when(alike, F.col("family")).otherwise(F.col("own")))
    overall = own.agg(*sums).first()
    base = ((overall["blocked"] or 0) + 1) / ((overall["blocked"] or 0) + (overall["allowed"] or 0) + 2)
    smoothed = lambda blocked, marked, above: (blocked + PRIOR * above) / (marked + PRIOR)
    hosts = own.groupBy("host").agg(*sums).select("host", smoothed(F.col("blocked"), marked, base).alias("host_purity"))
    above = family.join(hosts, "host").withColumn("family_purity", smoothed(F.col("family_blocked"), all_marked, F.col("host_purity")))
    groups = merged.groupBy("host", "family", "template").agg(*sums).join(above, ["host", "family"])
    level = F.when(F.col("template") == F.col("family"), F.col("host_purity")).otherwise(F.col("family_purity"))
    groups = groups.select("host", "family", "template", smoothed(F.col("blocked"), marked, level).alias("purity"), marked.alias("labels"))
    named = tree.select("host", "path", "family", "own").join(merged.select("host", "family", "own", "template"), ["host", "family", "own"])
    return named.join(groups, ["host", "family", "template"]).select("host", "path", "template", "purity", "labels")


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict, template, purity and labels; columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template", "purity", "labels", "_rule")]
    rows = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    action = F.col("_rule.action")
    urls = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(action == "block", 1)).alias("blocked"), F.count(F.when(action == "allow", 1)).alias("allowed")
    )
    out = rows.join(judge_templates(urls), ["host", "path"], "left")
    verdict = F.coalesce(action, F.when(F.col("purity") >= REJECT_FROM, "block").otherwise("allow"))
    return out.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity", "labels")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")
