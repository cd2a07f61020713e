"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form a class. A class's shingles have one global order: those that stand in no crowd
first, the longest before others and then by hash, then the crowded ones by their count. For sets that reach the threshold, the first l common shingles lie
in both l-prefixes, whose length is n - ceil(t * n) + l. Every class picks its l by estimated cost: a longer prefix is
more postings, but fewer documents share l of its shingles by chance. A pair is a candidate if m shingles, the
smaller l of the two, meet where the pair's first m common shingles can stand; then its whole sets are compared.

Components don't need all pairs of a crowd. First each posting list is compared with one leader only; then all pairs of
classes that are not connected yet are generated from the posting lists, the rows outside a list's largest component
against all. A class that has fewer shared shingles in its prefix than a pair asks for is left out of that pair
beforehand: edited copies whose own shingles fill their prefixes make no pairs, however large their crowd. Two classes
meet at their first m common shingles only: a posting knows the shingles before it, and where m of them are the
partner's as well the pair has met already. Of the pairs that are left, most are settled by parity bitmaps: a set's bits
flip once for each shingle, so two bitmaps differ in no more bits than the sets differ in shingles. Texts are fetched
for the others. No link between components is lost.

Defined results: a null text or one without words has an empty set and is linked with nothing; a text of fewer words
than a shingle has is one shingle; rows of one doc_id are documents of their own; component is the least key reached.
Other columns pass unchanged. Memory: a few MB of texts, the most crowded shingles (at most CROWDED).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._memory import tidy
from ._shared import aside, kept
from ._words import Words, chunks, longest_first, mix, shingle_sets, texts_of

SHINGLE, PERCENT = 4, 85
#: Of the shingles, the order knows so many of the most crowded by count. It only decides on cost, never on results.
CROWDED, CROWD = 1 << 16, 4
MATCHES = (1, 2, 3, 4, 5, 6, 8, 12)
#: Cost of a candidate in postings; share of uncrowded shingles that another document has by chance.
VERIFY_COST, CHANCE = 8.0, 0.05
#: A pair of a leader is compared if it shares so many postings.
LEADER_MATCHES = 3
BITMAP_BITS = 1 << 22


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(Words(texts, lower=True), k, longest_first)


def _marks(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def crowded(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most crowded shingles, sorted, and their counts, from the counts of CROWD or more within parts of the input."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts, 4 << 20):
                found, counts = np.unique(_sets(texts[a:b], k)[1], return_counts=True)
                found, counts = found[counts >= CROWD], counts[counts >= CROWD]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "docs"])

    rows = docs.select(text).mapInArrow(run, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    top = rows.orderBy(F.desc("docs"), "shingle").limit(CROWDED).collect()  # a bounded number
    hashes = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["docs"] for r in top], np.int64)[order]


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap of two to four bits a shingle, in which each shingle flips the bit that its hash names."""
    size = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer one is folded first, which keeps its parities."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def choose_matches(n: int, need: int, df: np.ndarray) -> int:
    """The number of matches of least estimated cost. df: documents of each shingle, in order, 1 if not crowded."""
    best, least = 1, np.inf
    for l in MATCHES:  # noqa: E741
        if l > need:
            break
        size = n - need + l
        prefix = df[:size]
        busy = prefix[prefix > 1]
        shared = float(np.sort(busy)[-l] - 1) if len(busy) >= l else 0.0
        cost = size + VERIFY_COST * (shared + CHANCE * (size - len(busy)) / 2 ** (l - 1))
        if cost < least:
            best, least = l, cost
    return best


def _classes(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(mark, n, l, prefix, parity): one row for each distinct set that isn't empty."""
    hot, counts = crowded(docs, text, k)
    shipped = docs.sparkSession.sparkContext.broadcast((hot, counts))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shipped.value
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                first, hashes = _sets(texts[a:b], k)
                marks = _marks(first, hashes)
                df = np.ones(len(hashes), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                    df = np.where(hot[at] == hashes, counts[at], 1)
                seen, out = set(), []
                for i in np.flatnonzero(np.diff(first)):
                    if marks[i] in seen:
                        continue
                    seen.add(marks[i])
                    own, of = hashes[first[i] : first[i + 1]], df[first[i] : first[i + 1]]
                    n = len(own)
                    need = (percent * n + 99) // 100
                    if of[-1] > 1 or of.max() > 1:
                        order = np.argsort(of, kind="stable")
                        own, of = own[order], of[order]
                    l = choose_matches(n, need, of)  # noqa: E741
                    out.append((marks[i], n, l, own[: n - need + l].view(np.int64), parity(own)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int32()),
                        pa.array([x[2] for x in out], pa.int32()),
                        pa.array([x[3] for x in out], pa.list_(pa.int64())),
                        pa.array([x[4] for x in out], pa.binary()),
                    ],
                    ["mark", "n", "l", "prefix", "parity"],
                )

    rows = docs.select(text).mapInArrow(run, "mark long, n int, l int, prefix array<bigint>, parity binary")
    return rows.groupBy("mark").agg(*(F.max(c).alias(c) for c in ("n", "l", "prefix", "parity")))


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """(token, mark, n, l, pos, j, s) of the tokens that two classes share which may be a pair.

    pos: the token's place in its class's order; j: its place among the class's shared tokens; s: their number.
    """
    tokens = classes.select("mark", "n", "l", F.posexplode("prefix").alias("pos", "token"))
    two = [F.min("mark").alias("low"), F.max("mark").alias("high"), F.min("n").alias("few"), F.max("n").alias("many"), F.count("*").alias("classes")]
    shared = tokens.groupBy("token").agg(*two).where((F.col("low") < F.col("high")) & ((F.col("classes") > 2) | (F.col("few") * 100 >= F.col("many") * percent)))
    shared = shared.select("token")  # a token of two classes only counts if their sizes can make a pair
    own = Window.partitionBy("mark")  # a prefix at most
    found = tokens.join(shared, "token").withColumn("j", F.row_number().over(own.orderBy("pos")) - 1)
    return found.select("token", "mark", "n", "l", "pos", "j", F.count("*").over(own).cast("int").alias("s"))


def _common(an: Column, bn: Column, percent: int) -> Column:
    """Common shingles of sets of these sizes that reach the threshold."""
    return F.floor((percent * (an + bn) + 99 + percent) / (100 + percent))


def _required(an: Column, al: Column, bn: Column, bl: Column, percent: int) -> Column:
    """Postings that a pair of these sizes and prefixes shares if it reaches the threshold.

    It has o = ceil(t / (1 + t) * (an + bn)) common shingles at least. The m-th of them in the global order has o - m after
    it, so it lies in a prefix of n - ceil(t * n) + l shingles if m <= o - ceil(t * n) + l.
    """
    least = _common(an, bn, percent)
    need = lambda n: F.floor((percent * n + 99) / 100)
    return F.least(least - need(an) + al, least - need(bn) + bl)


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether rows with the columns <a>n, <a>l, <a>s and <b>n, <b>l, <b>s can be a pair."""
    an, al, sa, bn, bl, sb = (F.col(x + y) for x in (a, b) for y in "nls")
    near = F.least(an, bn) * 100 >= F.greatest(an, bn) * percent
    return near & (F.least(sa, sb) >= _required(an, al, bn, bl, percent))


def _early(a: str, b: str, percent: int) -> Column:
    """Whether rows of the two classes meet at a token that can be among the pair's first m common ones, m the smaller l.

    Of o common tokens o - m follow the m-th, in both orders. And before it stand no more tokens that no other class
    has than a set may have beyond the common ones.
    """
    (an, al, pa_, ja), (bn, bl, pb, jb) = ([F.col(x + y) for y in ("n", "l", "pos", "j")] for x in (a, b))
    common, more = _common(an, bn, percent), F.least(al, bl) - 1
    return (pa_ + common <= an + more) & (pb + common <= bn + more) & (pa_ - ja + common <= an) & (pb - jb + common <= bn)


def _bits(marks: DataFrame):
    """A broadcast bit table of fixed size in which the bits of these marks are set."""
    bit = F.col("mark").bitwiseAND(BITMAP_BITS - 1)  # marks are mixed
    words = marks.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in words.toLocalIterator():  # at most BITMAP_BITS / 64 rows
        table[r["word"]] = r["bits"]
    return marks.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _in_bits(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & (BITMAP_BITS - 1)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _verified(docs: DataFrame, pairs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of marks whose sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct()
    shipped = _bits(ends)

    @tidy
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                first, hashes = _sets(texts[a:b], k)
                marks = _marks(first, hashes)
                rows = np.flatnonzero(np.diff(first))
                rows = rows[np.sort(np.unique(marks[rows], return_index=True)[1])] if len(rows) else rows
                rows = rows[_in_bits(shipped.value, marks[rows])]
                yield pa.RecordBatch.from_arrays([pa.array(marks[rows]), pa.array([texts[a + i] for i in rows], pa.binary())], ["mark", "body"])

    found = docs.select(text).mapInArrow(fetch, "mark long, body binary")
    # the bits hold back most texts that no pair needs; the join below is exact
    bodies = found.join(ends, "mark", "left_semi").groupBy("mark").agg(F.max("body").alias("body"))
    left, right = bodies.select(F.col("mark").alias("a"), F.col("body").alias("x")), bodies.select(F.col("mark").alias("b"), F.col("body").alias("y"))

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = np.asarray(part.column("a")), np.asarray(part.column("b"))
                both = dict(zip(a.tolist(), part.column("x").to_pylist())) | dict(zip(b.tolist(), part.column("y").to_pylist()))
                sets, names = {}, list(both)
                bodies = [both[m] for m in names]
                for i, j in chunks(bodies):
                    first, hashes = _sets(bodies[i:j], k)
                    sets.update(zip(names[i:j], (hashes[s:e] for s, e in zip(first[:-1], first[1:]))))
                good = []
                for s, e in zip(a.tolist(), b.tolist()):
                    x, y = sets[s], sets[e]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of marks whose parity bitmaps don't differ too much for the threshold."""
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("mark").alias(c), F.col("n").alias(c + "n"), F.col("parity").alias(c + "bits")), c)
    most = F.col("an") + F.col("bn") - 2 * _common(F.col("an"), F.col("bn"), percent)

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("abits").to_pylist(), batch.column("bbits").to_pylist(), batch.column("most").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([differing(x, y) <= m for x, y, m in rows], pa.bool_()))

    return pairs.select("a", "b", "abits", "bbits", most.alias("most")).mapInArrow(compare, "a long, b long")


def _ends() -> tuple[Column, Column]:
    """The two classes of a meeting; which of them is the other one depends on the token."""
    return F.least("omark", "mark").alias("a"), F.greatest("omark", "mark").alias("b")


def _leader_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): every class and the leaders of its tokens; a leader has the fewest shingles of its own."""
    own = F.col("l") - F.col("s") - F.floor((percent * F.col("n") + 99) / 100) + F.col("n")
    order = F.struct(own.alias("own"), F.xxhash64("mark").alias("h"), "mark", "n", "l", "s")
    leaders = postings.groupBy("token").agg(F.min(order).alias("leader"))
    leaders = leaders.select("token", *(F.col(f"leader.{c}").alias("o" + c) for c in ("mark", "n", "l", "s")))
    pairs = postings.join(leaders, "token").where(_possible("o", "", percent) & (F.col("omark") != F.col("mark")))
    return pairs.groupBy(*_ends()).agg(F.count("*").alias("met")).where(F.col("met") >= LEADER_MATCHES).select("a", "b")


def _open_pairs(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): all classes of different components that share as many postings as a pair of them must."""
    rows = postings.join(labels, postings.mark == labels.node, "left").withColumn("component", F.coalesce("component", "mark")).drop("node")
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    lists = sizes.groupBy("token").agg(F.count("*").alias("several"), F.max(F.struct("size", "component")).alias("most"))
    lists = lists.where("several > 1").select("token", F.col("most.component").alias("largest"))
    order = Window.partitionBy("mark").orderBy("pos").rowsBetween(-MATCHES[-1], -1)  # a prefix at most
    rows = kept(rows.join(lists, "token").withColumn("before", F.collect_list("token").over(order)))
    other = [F.col(c).alias("o" + c) for c in ("mark", "n", "l", "s", "pos", "j", "component", "before")]
    few = rows.where("component <> largest").select("token", *other)
    meet = (few.token == rows.token) & (F.col("ocomponent") != F.col("component")) & ((F.col("component") == F.col("largest")) | (F.col("omark") < F.col("mark")))
    first = F.size(F.array_intersect("before", "obefore")) < F.least("ol", "l")
    pairs = few.join(rows, meet & _possible("o", "", percent) & _early("o", "", percent) & first)
    return pairs.groupBy(*_ends()).agg(F.count("*").alias("met"), F.max(F.least("ol", "l")).alias("matches")).where("met >= matches").select("a", "b")


def linked_classes(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the marks of sets that are linked with another set."""
    classes = kept(_classes(docs, text, k, percent))
    postings = kept(_postings(classes, percent))

    def linked(pairs: DataFrame) -> DataFrame:
        return kept(_verified(docs, kept(_near(pairs, classes, percent)), text, k, percent))

    links = linked(_leader_pairs(postings, percent))
    links = links.union(linked(_open_pairs(postings, components(links), percent)))
    return components(links)


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, group: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with n_shingles and component_id, the least key that links reach from a document, itself included.

    keep: the columns of docs that are wanted, the key among them; all, if not given.
    group: the name of one more column, a mark of the document's component, null for a document that is alone in it.
    """
    names = [c for c in (keep or docs.columns) if c not in ("n_shingles", "component_id", "_mark", group)]
    marked = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_shingles", T.LongType()), T.StructField("_mark", T.LongType())])

    labels = linked_classes(docs, text, k, percent)
    ids = kept(docs.select(key, text).mapInArrow(mark_only(key, text, k), f"_mark long, _key {docs.schema[key].dataType.simpleString()}"))
    named = ids.join(labels, ids["_mark"] == labels["node"], "left").select("_mark", "_key", F.coalesce("component", "_mark").alias("_group"))
    groups = named.groupBy("_group").agg(F.min("_key").alias("_least"), F.count("*").alias("_size")).where("_size > 1").drop("_size")
    classes = kept(named.groupBy("_mark").agg(F.max("_group").alias("_group")).join(groups, "_group").select(F.col("_mark").alias("mark"), "_least", "_group"))
    shipped = _bits(classes)

    def marks_of(grouped: bool):
        """The rows that may be of a group, or all the others, which need no join."""

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch.column(text))
                for a, b in chunks(texts):
                    first, hashes = _sets(texts[a:b], k)
                    n, marks = np.diff(first), _marks(first, hashes)
                    part = pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(names).columns, pa.array(n, pa.int64()), pa.array(marks)], [*names, "n_shingles", "_mark"])
                    yield part.filter(pa.array(((n > 0) & _in_bits(shipped.value, marks)) == grouped))

        return run

    of_group = lambda mark: [mark.alias(group)] if group else []
    source = docs.select(*names, *([text] if text not in names else []))
    alone = source.mapInArrow(marks_of(False), marked).select(*names, "n_shingles", F.col(key).alias("component_id"), *of_group(F.lit(None).cast("long")))
    rows = source.mapInArrow(marks_of(True), marked)
    joined = rows.join(classes, rows["_mark"] == classes["mark"], "left").select(*names, "n_shingles", F.coalesce("_least", key).alias("component_id"), *of_group(F.col("_group")))
    return alone.unionByName(joined)


def mark_only(key: str, text: str, k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                first, hashes = _sets(texts[a:b], k)
                has = np.diff(first) > 0
                part = pa.RecordBatch.from_arrays([pa.array(_marks(first, hashes)), batch.column(key).slice(a, b - a)], ["_mark", "_key"])
                yield part.filter(pa.array(has))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates (five-word shingles, 0.8 or more) the document of least id."""
    rows, back = aside(docs, "doc_id", "text")
    names = rows.columns
    out = join_components(rows, k=5, percent=80, group="_component")
    out = out.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    if docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():  # rows of one id in one component: that of least text stays
        several = F.col("doc_id").isNotNull() & F.col("_component").isNotNull()
        one = out.where(several).groupBy("_component", "doc_id").agg(F.min(F.struct("text", *(c for c in names if c not in ("doc_id", "text")))).alias("_row"))
        out = one.select("doc_id", "_row.*").select(*names).unionByName(out.where(~several).select(*names))
    return back(out)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs, keep=["doc_id"]).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
