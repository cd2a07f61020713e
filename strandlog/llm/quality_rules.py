"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules drop texts of few words or of many repeated ones. Beyond them, rules compare shares of a text's counts with
cutoffs that labelled rows choose, for each stratum (language):

- Each rule has a grid of cutoffs from strict to lenient. On a fifth of the labelled rows it takes the cutoff of the
  largest gain, the bad rows it catches less COST times the good ones (the most lenient of equals); without a gain the
  rule is off.
- The other rows are the holdout. A level loosens all rules of a stratum by so many steps of their grids. A level passes
  if the exact binomial probability of no more false rejections than the holdout's, were their rate RISK, is at most
  DOUBT divided by the number of strata (Bonferroni). Levels are tested from the most lenient on and the testing ends
  with the first that fails (fixed sequence), so the correction for levels costs nothing. The strictest level passed is
  used; a stratum where none passes, as with too few labels, keeps all that the base rules leave.

So with a confidence of 1 - DOUBT the rules drop at most a share RISK of the good texts that the base rules leave, in
every stratum at once.

Defined results: a null text is an empty one and fails the base; a null or unlisted language is the stratum `other`; a
null or unknown label is not used, repeated labels count once, and a key with both labels counts as both; without labels
only the base rules drop. A null key has no label. Words are separated by ASCII white space; windows of words are
compared by 64-bit hashes. Other columns pass unchanged; columns named like the operator's own are replaced. A row needs
memory for its own words; tables sent along have a row for each listed stratum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
RISK, DOUBT = 0.05, 0.05
COST = 10
LEVELS = 8
FOLDS = 5
STRATA = ("de", "en", "es", "fr")
OTHER = "other"

#: Steps of each rule's grid. A rule compares scale * part with cutoff * whole.
STEPS = 24
RULES = (
    # part, whole, scale, strictest cutoff, steps that double it (or halve it, if the rule is on small values)
    ("n_symbols", "word_chars", 1000, 5, 4),
    ("n_dup_lines", "n_lines", 100, 5, 4),
    ("n_repeat_words", "n_words", 100, 5, 8),
    ("word_chars", "n_words", 100, 500, 8),
    ("word_chars", "n_words", 100, 500, -8),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def grid(strictest: int, doubling: int) -> list[int]:
    return [round(strictest * 2 ** (i / doubling)) for i in range(STEPS)]


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _size(x: Column) -> Column:
    return F.array_size(x).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words are in a window of so many words that stands twice or more in the array."""
    n = F.array_size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            other = lambda j: F.get(s, j).getField("h")
            twice = F.filter(s, lambda x, j: F.coalesce(x.h == other(j - 1), F.lit(False)) | F.coalesce(x.h == other(j + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.i))

        def length(places: Column) -> Column:
            steps = F.transform(places, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        distinct = F.array_size(F.array_distinct(hashes)) == F.array_size(hashes)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(_bind(_bind(ordered, repeats), length))

    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n > window, _bind(hashes, covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES: words, their code points, symbols, lines equal to an earlier one, repeated words, lines with a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[ \t-\r]+"), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    of_words = _bind(words, lambda w: F.struct(_size(w).alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeats")))
    of_lines = _bind(lines, lambda x: F.struct(_size(x).alias("n"), (_size(x) - _size(F.array_distinct(x))).alias("dups")))
    symbols = (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long")
    names = [c for c in docs.columns if c not in MEASURES]
    rows = docs.select(*names, of_words.alias("_words"), of_lines.alias("_lines"), symbols.alias("n_symbols"))
    found = {"n_words": "_words.n", "word_chars": "_words.chars", "n_symbols": "n_symbols", "n_dup_lines": "_lines.dups", "n_repeat_words": "_words.repeats", "n_lines": "_lines.n"}
    return rows.select(*names, *(F.col(found[c]).alias(c) for c in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fired() -> Column:
    """For each rule, how many cutoffs of its grid, from the strictest on, are broken."""

    def of(part: str, whole: str, scale: int, strictest: int, doubling: int) -> Column:
        cutoffs = F.array(*map(F.lit, grid(strictest, doubling)))
        value, beyond = scale * F.col(part), lambda c: c * F.col(whole)
        return F.array_size(F.filter(cutoffs, lambda c: (value > beyond(c)) if doubling > 0 else (value < beyond(c))))

    return F.array(*(of(*rule) for rule in RULES))


def binomial_below(k: Column, n: Column, rate: float) -> Column:
    """The probability of k successes or fewer in n trials, for k up to n * rate; 1 beyond, where it is no use as a test.

    A sum of terms, each worked out from the one before by logarithms.
    """
    odds = math.log(rate) - math.log1p(-rate)
    start = F.struct((n * math.log1p(-rate)).alias("log"), F.exp(n * math.log1p(-rate)).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        log = a.getField("log") + F.log(((n - i + 1) / i).cast("double")) + odds
        return F.struct(log.alias("log"), (a.getField("sum") + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, add).getField("sum")))


def held_out(key: str) -> Column:
    """The rows whose false rejections are counted: four of five, by their key's digest."""
    return F.conv(F.substr(F.md5(F.col(key).cast("string").cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % FOLDS != 0


def _excess(tuned: Column) -> Column:
    """The level up to which a row is rejected (it is rejected below this level); null if no rule is on."""
    return F.array_max(F.zip_with("fired", tuned, lambda p, i: p - i))


def thresholds(rows: DataFrame, strata: int) -> DataFrame:
    """(stratum, tuned, level, n_good, n_rejected) from labelled rows (stratum, fired, good, held).

    tuned: per rule the step of its grid, null where it is off; level: how many steps looser it is used, null where the
    stratum has no level that passes. strata: how many strata are tested.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    parts = rows.where(~F.col("held")).select("stratum", "good", F.posexplode("fired").alias("rule", "p"))
    parts = parts.groupBy("stratum", "rule", "p").agg(one(F.col("good")).alias("good"), one(~F.col("good")).alias("bad"))
    of_rule = parts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("p", (F.col("bad") - COST * F.col("good")).alias("gain"))).alias("parts"))
    gain = lambda i: F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.when(x.p > i, x.gain).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.struct(gain(i).alias("gain"), i.alias("at"))))
    of_rule = of_rule.select("stratum", "rule", best.alias("best"))
    step = F.when(F.col("best.gain") > 0, F.col("best.at"))
    tuned = of_rule.groupBy("stratum").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule", step.alias("at")))), lambda x: x.at).alias("tuned"))
    good = rows.where(F.col("held") & F.col("good")).join(F.broadcast(tuned), "stratum")  # a row for each stratum
    counts = good.groupBy("stratum", F.coalesce(_excess(F.col("tuned")), F.lit(-STEPS)).alias("excess")).agg(F.count("*").alias("n"))
    counts = counts.groupBy("stratum").agg(F.collect_list(F.struct("excess", "n")).alias("parts"), F.sum("n").alias("n_good"))
    rejected = lambda level: F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.when(x.excess > level, x.n).otherwise(0))
    passes = lambda level: binomial_below(rejected(level), F.col("n_good"), RISK) <= DOUBT / strata
    fails = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: ~passes(level))
    strictest = F.coalesce(F.array_max(fails) + 1, F.lit(0))
    counts = counts.withColumn("level", strictest).where(F.col("level") < LEVELS)
    found = counts.select("stratum", "level", "n_good", rejected(F.col("level")).alias("n_rejected"))
    return tuned.join(found, "stratum", "left")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", strata: tuple[str, ...] = STRATA, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, MEASURES, base_failed, stratum, kept) of every row. labels: key and quality, 1 for good and 0 for bad."""
    stratum = F.when(F.col(lang).isin(*strata), F.col(lang)).otherwise(F.lit(OTHER))
    rows = docs.select(key, *(c for c in keep if c not in (key, "_stratum", *MEASURES)), stratum.alias("_stratum"), text)
    names = [c for c in rows.columns if c not in (text, "_stratum")] if text not in keep else [c for c in rows.columns if c != "_stratum"]
    rows = measured(rows, text).select(*names, F.col("_stratum").alias("stratum"), *MEASURES)
    rows = kept(rows.withColumn("base_failed", base_failed()).withColumn("fired", fired()))
    marks = labels.where(F.col("quality").isin(0, 1)).select(key, (F.col("quality") == 1).alias("good")).distinct()
    known = rows.where(~F.col("base_failed")).select(key, "stratum", "fired").join(marks, key).select("stratum", "fired", "good", held_out(key).alias("held"))
    cuts = thresholds(known, len(strata) + 1).select("stratum", "tuned", "level")
    out = rows.join(F.broadcast(cuts), "stratum", "left")  # a row for each listed stratum
    rejected = F.coalesce(_excess(F.col("tuned")) > F.col("level"), F.lit(False))
    return out.select(*names, *MEASURES, "base_failed", "stratum", (~F.col("base_failed") & ~rejected).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _broken(part: str, whole: str, scale: int, strictest: int, doubling: int) -> str:
    return f"len(list_filter({grid(strictest, doubling)}, lambda c: {scale} * {part} {'>' if doubling > 0 else '<'} c * {whole}))"


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS x(i)),
b AS (SELECT r, i FROM g JOIN (SELECT r, s FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, s)),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM b, range({WINDOW}) AS x(j) GROUP BY r),
m AS (SELECT doc_id, CASE WHEN lang IN {STRATA} THEN lang ELSE '{OTHER}' END AS stratum, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, [{", ".join(_broken(*x) for x in RULES)}] AS fired FROM m),
k AS (SELECT stratum, fired, quality = 1 AS good, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {FOLDS} <> 0 AS held
  FROM f JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) USING (doc_id) WHERE NOT base_failed),
gain AS (SELECT stratum, rule, i, sum(CASE WHEN fired[rule] > i THEN CASE WHEN good THEN -{COST} ELSE 1 END ELSE 0 END) AS gain
  FROM k, range(1, {len(RULES) + 1}) AS x(rule), range({STEPS}) AS y(i) WHERE NOT held GROUP BY ALL),
tuned AS (SELECT stratum, rule, arg_max(i, (gain, i)) AS i FROM gain GROUP BY ALL HAVING max(gain) > 0),
known AS (SELECT DISTINCT stratum FROM k WHERE NOT held),
h AS (SELECT n, stratum, (SELECT max(fired[rule] - i) FROM tuned WHERE tuned.stratum = h.stratum) AS excess FROM (SELECT row_number() OVER () AS n, * FROM k WHERE held AND good) h JOIN known USING (stratum)),
v AS (SELECT stratum, level, count(*) AS n, count(*) FILTER (WHERE excess > level) AS k FROM h, range({LEVELS}) AS x(level) GROUP BY ALL),
p AS (SELECT stratum, level, CASE WHEN k > n * {RISK} THEN 1 ELSE
  (SELECT sum(exp(lgamma(n + 1.0) - CASE WHEN i > 0 THEN lgamma(i + 1.0) ELSE 0 END - CASE WHEN n > i THEN lgamma(n - i + 1.0) ELSE 0 END + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(k + 1) AS x(i)) END AS p FROM v),
level AS (SELECT stratum, coalesce(max(level) FILTER (WHERE p > {DOUBT} / {len(STRATA) + 1}) + 1, 0) AS level FROM p GROUP BY stratum HAVING coalesce(max(level) FILTER (WHERE p > {DOUBT} / {len(STRATA) + 1}) + 1, 0) < {LEVELS}),
o AS (SELECT f.*, (SELECT max(fired[rule] - i) FROM tuned WHERE tuned.stratum = f.stratum) > level AS rejected FROM f LEFT JOIN level USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, FALSE) AS kept FROM o
"""
