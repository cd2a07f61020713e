"""Substring dedup by relative Lempel-Ziv factors against every document of smaller id.

The reference is indexed in blocks (see _blocks): an anchor, the least of the five-word hashes in a window, first tells
which windows can occur twice at all; only those windows' hashes are sent, each with the block's earliest place of it
(document, then word), and answered with the earliest place of all blocks. A document is then parsed: places of one
source document that lie on one diagonal (the same distance between both texts) and leave no word out make a factor,
and so each factor stands in its source word by word. From left to right the factor that reaches furthest is taken and
the parse goes on behind it; the windows over the border of two factors are checked as well, and factors that hold
such a window are kept beside those of the parse. A factor is the longest on its diagonal as far as the source is the
earliest holder; another document that holds more of it at once isn't looked for, which changes where factors end but
not what they cover. The words removed are those of all windows that an earlier document has.

Copies cost one entry a block and window, whatever their number. Memory: a block of a few MB and a bucket of hashes.

Defined results: a null text has no words and stays null; a document of fewer than `window` words loses nothing;
rows of equal doc_id don't remove each other's words, and as sources count as one (a factor may join places of both);
rows with a null doc_id keep their text and are no source. Other columns pass unchanged; columns named like the
operator's own are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _blocks as B
from ._memory import tidy_cogroup, tidy_group
from ._shared import aside
from ._words import Words, chunks, mix, texts_of

WINDOW = 13
ANCHOR = 5

_SPAN = T.StructType([*(T.StructField(c, T.LongType()) for c in ("start", "stop", "source", "at")), T.StructField("border", T.BooleanType())])
_OUT = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType(), "spans": T.ArrayType(_SPAN)}


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole windows and each one's anchor, cut."""
    places = words.whole(window)
    if not len(places):
        return places, np.empty(0, np.uint64)
    least = B.cut(words.shingles(anchor))
    steps, have = window - anchor + 1, 1
    while have < steps:  # a sliding minimum whose reach doubles
        by = min(have, steps - have)
        least = np.minimum(least[: len(least) - by], least[by:])
        have += by
    return places, least[places]


def _ids(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[key].combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _read(table: pa.Table, key: str, text: str, window: int, anchor: int):
    """Per few MB of a block: its rows' range, words, and of the windows the places, those in their documents, hashes, anchors, doc ids and whether they count."""
    ids, none = _ids(table, key)
    texts = texts_of(table[text])
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        places, anchors = _windows(words, window, anchor)
        owner = words.text_of_word()[places]
        at = (places - words.first[owner]).astype(np.int32)
        yield a, b, words, places, at, words.shingles(window)[places], anchors, ids[owner + a], ~none[owner + a]


def _unpacked(table: pa.Table) -> list[tuple]:
    """Each row's hashes, ids and places."""
    columns = (table[c].to_pylist() for c in ("hashes", "ids", "at"))
    return [(np.frombuffer(h, np.uint64), np.frombuffer(i, np.int64), np.frombuffer(x, np.int32)) for h, i, x in zip(*columns)]


def _earliest(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and of each the smallest id and its first place there."""
    order = np.lexsort((at, ids, hashes))
    hashes, ids, at = hashes[order], ids[order], at[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new], ids[new], at[new]


def _all(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and places of all parts."""
    kinds = np.uint64, np.int64, np.int32
    return tuple(np.concatenate([np.empty(0, kind), *(x[i] for x in parts)]) for i, kind in enumerate(kinds))


def factors(doc: np.ndarray, place: np.ndarray, source: np.ndarray, at: np.ndarray, window: int) -> list[tuple]:
    """(doc, start, stop, source, at, border) of the factors of windows that have an earlier place, by document.

    doc: a number for each window's document; place: its first word there; source, at: where it stood earlier.
    border: the factor isn't one of the greedy parse but holds windows over its borders.
    """
    diagonal = at.astype(np.int64) - place
    order = np.lexsort((place, diagonal, source, doc))
    doc, place, source, at, diagonal = (x[order] for x in (doc, place, source, at, diagonal))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (diagonal[1:] != diagonal[:-1]) | (np.diff(place) > window)
    begin = np.flatnonzero(new)
    stop = place[np.append(begin[1:], len(place)) - 1] + window if len(begin) else begin
    d, start, source, at = doc[begin], place[begin], source[begin], at[begin]
    order = np.lexsort((-stop, start, d))
    rows = list(zip(*(x[order].tolist() for x in (d, start, stop, source, at))))
    out, i = [], 0
    while i < len(rows):
        now, reach = rows[i][0], rows[i][1]
        taken, others = [], []
        while i < len(rows) and rows[i][0] == now:
            reach, best = max(reach, rows[i][1]), None
            while i < len(rows) and rows[i][0] == now and rows[i][1] <= reach:  # of those that begin by now, the one that reaches furthest
                if best is None or rows[i][2] > best[2]:
                    best, old = rows[i], best
                    others += [old] if old else []
                else:
                    others.append(rows[i])
                i += 1
            if best[2] > reach:
                taken.append((*best, False))
                reach = best[2]
            else:
                others.append(best)
        j = 0
        for x in sorted(others, key=lambda x: x[2]):  # those within a taken one hold no window that it doesn't hold
            while j < len(taken) and taken[j][2] < x[2]:
                j += 1
            if j == len(taken) or taken[j][1] > x[1]:
                out.append((*x, True))
        out += taken
    return out


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed, kept (the words left, joined by one space; null for a null text) and spans.

    spans: (start, stop, source, at, border), the factors: words start to stop - 1 stand in document `source` from word
    `at` on.
    """
    columns = [c for c in docs.columns if c not in (*_OUT, "_block")]
    docs = docs.select(*columns)
    blocks, n = B.in_blocks(docs, text, [key, text])
    buckets = max(1, n // 4)

    def anchors_of(table: pa.Table) -> np.ndarray:
        found = [np.unique(anchors[real]) for *_, anchors, _, real in _read(table, key, text, window, anchor)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    @tidy_cogroup
    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        keys, found = B.joined(shared), []
        if len(keys) and table.num_rows:
            for *_, at, hashes, anchors, ids, real in _read(table, key, text, window, anchor):
                real &= B.member(anchors, keys)
                found.append(_earliest(hashes[real], ids[real], at[real]))
        hashes, ids, at = _earliest(*_all(found))
        borders = B.by_bucket(hashes, 64, buckets)
        full = np.flatnonzero(np.diff(borders))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "_block": pa.array([table["_block"][0].as_py()] * len(full) if len(full) else [], pa.int32()),
                "hashes": pa.array([hashes[borders[i] : borders[i + 1]].tobytes() for i in full], pa.binary()),
                "ids": pa.array([ids[borders[i] : borders[i + 1]].tobytes() for i in full], pa.binary()),
                "at": pa.array([at[borders[i] : borders[i + 1]].tobytes() for i in full], pa.binary()),
            }
        )

    @tidy_group
    def answer(table: pa.Table) -> pa.Table:
        sent = _unpacked(table)
        hashes, ids, at = _earliest(*_all(sent))
        out = []
        for h, i, _ in sent:
            place = np.searchsorted(hashes, h)
            place = place[ids[place] < i]
            out.append((hashes[place], ids[place], at[place]))
        columns = {name: pa.array([x[i].tobytes() for x in out], pa.binary()) for i, name in enumerate(("hashes", "ids", "at"))}
        return pa.table({"_block": table["_block"].combine_chunks(), **columns})

    given = docs.schema
    schema = T.StructType([*given.fields, *(T.StructField(k, v) for k, v in _OUT.items())])

    @tidy_cogroup
    def parse(table: pa.Table, earlier: pa.Table) -> pa.Table:
        own = list(_read(table, key, text, window, anchor)) if table.num_rows else []
        hashes, first, first_at = _earliest(*_all([*_unpacked(earlier), *((h[real], i[real], at[real]) for *_, at, h, _, i, real in own)]))
        kept: list[bytes | None] = []
        n_words, n_removed, spans = [], [], []
        for a, b, words, places, own_at, h, _, ids, real in own:
            found = np.flatnonzero(real)
            place = np.searchsorted(hashes, h[found])
            earlier_is = first[place] < ids[found]
            found, place = found[earlier_is], place[earlier_is]
            docs_at = words.text_of_word()[places[found]]
            of_doc: list[list] = [[] for _ in range(b - a)]
            gone = np.zeros(len(words.hashes) + 1, np.int64)
            for d, start, stop, source, at, border in factors(docs_at, own_at[found].astype(np.int64), first[place], first_at[place], window):
                of_doc[d].append({"start": start, "stop": stop, "source": source, "at": at, "border": border})
                gone[words.first[d] + start] += 1
                gone[words.first[d] + stop] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            for d in range(b - a):
                lo, hi = words.first[d], words.first[d + 1]
                mask = stays[lo:hi]
                if mask.all():
                    kept.append(b" ".join(words.data[words.starts[lo] : words.ends[hi - 1]].split()) if hi > lo else b"")
                else:
                    kept.append(b" ".join(words.data[s:e] for s, e in zip(words.starts[lo:hi][mask], words.ends[lo:hi][mask])))
                n_words.append(hi - lo)
                n_removed.append(int(hi - lo - mask.sum()))
            spans += of_doc
        out = table.select(given.names)
        none = table[text].is_null().to_pylist()
        out = out.append_column("n_words", pa.array(n_words, pa.int64()))
        out = out.append_column("n_removed", pa.array(n_removed, pa.int64()))
        out = out.append_column("kept", pa.array([None if x else k.decode("utf-8", "replace") for k, x in zip(kept, none)], pa.string()))
        kind = pa.list_(pa.struct([*((c, pa.int64()) for c in ("start", "stop", "source", "at")), ("border", pa.bool_())]))
        return out.append_column("spans", pa.array(spans, kind))

    shared = B.shared_keys(blocks, n, anchors_of)
    sent = blocks.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(send, "bucket int, _block int, hashes binary, ids binary, at binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "_block int, hashes binary, ids binary, at binary").where(F.octet_length("hashes") > 0)
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(parse, schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the words of duplicate spans; one that loses nothing keeps its text as it was."""
    rows, back = aside(docs, "doc_id", "text", "n_chars")
    out = dedup_substrings(rows)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return back(out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY 1),
c AS (SELECT DISTINCT g.doc_id, i + j AS p FROM g JOIN f USING (s), range(13) AS r(j) WHERE first < g.doc_id),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
