"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import bpe, chat, decontaminate, jaccard_join, license_scan, quality, rlz_dedup, sketch, url_filter, warc
from strandlog.llm._graph import components
from strandlog.llm._words import WHITESPACE, Words, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n: int = 120, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghéñ漢") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    bases = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 120))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        kind = i % 6
        words = r.choice(bases).split()
        if kind == 1:
            words[r.randrange(len(words))] = "changed"
        elif kind == 2:
            words = [r.choice(vocabulary) for _ in range(r.randint(1, 200))]
        elif kind == 3:
            words = words[:10] + passage.split() + words[10:]
        elif kind == 4:
            words = words[: r.randint(0, 6)]
        out.append((i, (" " if kind != 5 else "\n\t ").join(words), "en", "s", len(" ".join(words))))
    out += [(n, None, "en", "s", 0), (n + 1, "", None, "s", 0), (n + 2, " \n\t", "en", None, None), (n + 3, passage + " " + passage, "en", "s", 1), (n + 4, "word " * 3000, "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_and_sets():
    words = Words([b"a b c d e", b"", b"b c  d", b" x ", b"a b c d e"], WHITESPACE)
    first, hashes = shingle_sets(words, 4)
    assert words.counts().tolist() == [5, 0, 3, 1, 5]
    assert np.diff(first).tolist() == [2, 0, 1, 1, 2]
    assert hashes[:2].tolist() == hashes[-2:].tolist()


def thue_morse(n, a="a", b="b"):
    """n letters and their complement: a polynomial hash modulo a power of two can't tell them apart."""
    text = [a]
    while len(text) < n:
        text += [b if x == a else a for x in text]
    return text[:n], [b if x == a else a for x in text[:n]]


@pytest.mark.parametrize("n", (8, 64, 65, 1024, 2048, 4096))
def test_words_of_a_repeated_pattern_differ(n):
    one, other = map("".join, thue_morse(n))
    words = Words([one.encode(), other.encode(), one.encode(), (one + "\0").encode()])
    assert words.hashes[0] == words.hashes[2] and len(set(words.hashes.tolist())) == 3
    one, other = (" ".join(x).encode() for x in thue_morse(4096))
    for k in (1, 2, 4, 5, 8, 13):
        shingles = Words([one, other]).shingles(k)
        spans = {tuple(x[i : i + k]) for x in ((one + b" " + other).split(),) for i in range(8192 - k + 1)}
        assert len(set(shingles.tolist())) == len(spans)


def test_operators_on_words_of_a_repeated_pattern(spark, vocabulary):
    one, other = map("".join, thue_morse(1024))
    tables = bpe.vocabulary(open(vocabulary[0], "rb").read())
    for x, y in zip((one, other), tables.encode([one.encode(), other.encode()])):
        assert b"".join(tables.tokens[i] for i in y.tolist()) == x.encode()
    table = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(table, k=4, percent=85).collect()}
    assert got == {1: 1, 2: 2}
    equal = " ".join(f"w{i}" for i in range(12))
    table = spark.createDataFrame([(1, f"{equal} {one}"), (2, f"{equal} {other}")], "doc_id long, text string")
    assert {x.n_removed for x in rlz_dedup.dedup_substrings(table).collect()} == {0}
    a, b = sketch.sketches([one.encode(), other.encode()], one_of=1)
    assert a.tolist() != b.tolist()


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long").where("a <> b")).collect()}
    assert all(find(x) == c for x, c in got.items()) and set(got) >= {x for a, b in links if a != b for x in (a, b)}


def remove_repeated(rows, window=13):
    first = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup(docs, rows):
    extra = docs.withColumn("spans", F.lit(1)).withColumn("kept", F.lit("x"))
    text = {d: t for d, t, *_ in rows}
    got = {x.doc_id: x for x in rlz_dedup.dedup_substrings(extra).collect()}
    for d, (n, gone, kept) in remove_repeated(rows).items():
        assert (got[d].n_words, got[d].n_removed, got[d].kept or "") == (n, gone, kept)
        words = (text[d] or "").encode().split()
        covered = set()
        for s in got[d].spans:
            assert s.source < d and s.stop - s.start >= 13
            assert words[s.start : s.stop] == text[s.source].encode().split()[s.at : s.at + s.stop - s.start], "a factor stands in its source"
            covered |= set(range(s.start, s.stop))
        assert len(covered) == gone
        parse = [s for s in got[d].spans if not s.border]
        assert parse == sorted(parse, key=lambda s: (s.start, s.stop)) and all(a.stop < b.stop for a, b in zip(parse, parse[1:]))
    assert got[120].kept is None and got[121].kept == ""


def test_factors():
    place = lambda *x: np.array(x)
    # a gap of 12 places on one diagonal leaves no word out; a window over the border of two factors is one of its own
    assert rlz_dedup.factors(place(0, 0), place(0, 13), place(5, 5), place(7, 20), 13) == [(0, 0, 26, 5, 7, False)]
    assert rlz_dedup.factors(place(0, 0), place(0, 14), place(5, 5), place(7, 21), 13) == [(0, 0, 13, 5, 7, False), (0, 14, 27, 5, 21, False)]
    got = rlz_dedup.factors(place(0, 0, 0, 1), place(0, 7, 13, 2), place(5, 4, 5, 5), place(0, 3, 50, 1), 13)
    assert got == [(0, 7, 20, 4, 3, True), (0, 0, 13, 5, 0, False), (0, 13, 26, 5, 50, False), (1, 2, 15, 5, 1, False)]


@pytest.mark.parametrize("n", range(16))
def test_windows_of_few_words(n):
    places, anchors = rlz_dedup._windows(Words([b" ".join(b"w%d" % i for i in range(n))]), 13, 5)
    assert places.tolist() == list(range(max(0, n - 12))) and len(anchors) == len(places)


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text)], "doc_id long, text string")
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in rlz_dedup.dedup_substrings(df).collect())
    assert got == [(False, 0, 0), (True, 5, 0), (True, 5, 0), (True, 9, 30)]
    assert rlz_dedup.dedup_substrings(df.limit(0)).collect() == []


def shingled(text, k):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, k, percent):
    sets = {d: shingled(t, k) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.join_components(docs.withColumn("component_id", F.lit("x")), k=k, percent=percent).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_parity_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(4)
    for _ in range(200):
        x, y = (r.integers(0, 1 << 63, r.integers(1, 300)).astype(np.uint64) for _ in "xy")
        common = r.integers(0, 1 << 63, r.integers(0, 900)).astype(np.uint64)
        bits = [jaccard_join.parity(np.unique(np.concatenate((z, common)))) for z in (x, y)]
        assert jaccard_join.differing(*bits) <= len(np.setxor1d(np.append(x, common), np.append(y, common)))


def drifting(seed: int) -> list[tuple[int, str]]:
    """Four chains of near copies, each edited from an earlier one of its chain."""
    r = random.Random(seed)
    rows, chains = [], []
    for _ in range(4):
        chains.append([["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 160))]])
    for i in range(160):
        chain = r.choice(chains)
        words = list(r.choice(chain[-12:]))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(["new", "other", "".join(r.choice("xyz") for _ in range(6))])
        chain.append(words)
        rows.append((i, " ".join(words)))
    return rows


def test_jaccard_join_drifting_chains(spark):
    """Twenty tables of chains, joined as one: no table has a word of another."""
    rows = [(seed * 1000 + d, " ".join(f"{seed}{w}" for w in t.split())) for seed in range(20) for d, t in drifting(seed)]
    sets, parent = {d: shingled(t, 4) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if b // 1000 != a // 1000:
                break
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in ids}


def test_jaccard_join_crowd_without_all_pairs(spark):
    """A crowd of near copies whose links need more than one leader."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {d: shingled(t, 4) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a + 1, 150):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in sets}


def test_jaccard_join_crowds_joined_by_one_pair(spark):
    """Two crowds whose only link is a pair that must meet at several tokens, some of which one crowd crowds, some the other."""
    r = random.Random(11)
    fresh = lambda w, at, n, size: [*w[:at], *("".join(r.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n)), *w[at + n :]]
    crowds = []
    for g in range(8):
        x = fresh(fresh(fresh(fresh([""] * 203, 0, 203, 3), 0, 16, 30), 191, 12, 8), 100, 9, 8)
        y = fresh(x, 0, 16, 30)  # the threshold's last place: 184 shingles of 216
        own = [x, y]
        for end, at, n, pairs in ((x, 191, 12, 2 + g % 2), (y, 100, 9, 3 - g % 2)):
            for _ in range(pairs):
                copy = fresh(end, at, n, 8)
                own += [copy, fresh(copy, 50, 1, 3)]
        crowds.append(own)
    rows = [(12 * g + i, " ".join(own[i])) for i in range(12) for g, own in enumerate(crowds)]
    sets = {d: shingled(t, 4) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    least = {d: d for d in sets}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert len(set(least.values())) == 8
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 12), "doc_id long, text string")  # few of a crowd in a part, so that prefixes ask for several matches
    assert {x.doc_id: x.component_id for x in jaccard_join.join_components(docs).collect()} == least


def test_jaccard_join_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "A B C d e"), (7, "other words are here now"), (3, "")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id) for x in jaccard_join.join_components(df).collect())
    assert got == [(0, 2, 7), (3, 0, 3), (7, 2, 7), (7, 2, 7)]
    assert jaccard_join.join_components(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_round_trip(docs, rows, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = {t: i for i, t in enumerate(bpe.token_list(open(path, "rb").read())) if t}
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(docs, path).drop("text"), path).collect()}
    for d, t, *_ in rows:
        ids = theirs.encode_ordinary(t or "")
        assert np.frombuffer(got[d].ids, "<u4").tolist() == ids and got[d].n_tokens == len(ids)
        assert bytes(got[d].decoded) == (t or "").encode()


def test_bpe_odd_texts(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    v = bpe.Vocabulary(open(path, "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(2)
    some = ["", " ", "don't  we'll 'tis ''s 's", "a" * 5000, "ab" * 3000, " " * 300 + "x", "'re've'm", "😀😀 é́"]
    some += ["".join(r.choice("ab 'sstrevlld\n\t    é漢0129!?-ñ😀́'") for _ in range(r.randrange(60))) for _ in range(500)]
    some += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0xD7FF), r.randrange(0x10000, 0x10FFFF)])) for _ in range(r.randrange(40))) for _ in range(300)]
    assert [x.tolist() for x in v.encode([t.encode() for t in some])] == [theirs.encode_ordinary(t) for t in some]


@pytest.mark.parametrize("unit", ["st", "in", "abc", "aab", "zq", ""])
def test_bpe_long_pieces(vocabulary, unit):
    """Pieces of many equal pairs, as the public library merges them, in time proportional to their length."""
    import time

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path, pattern = vocabulary
    own = bpe.vocabulary(open(path, "rb").read())
    public = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    r = random.Random(2)
    text = lambda n: unit * (n // len(unit)) if unit else "".join(r.choice("stinaeo") for _ in range(n))
    for n in (64, 1000, 20_000):
        x = text(n)
        assert own.encode([x.encode()])[0].tolist() == public.encode_ordinary(x)
    took = []
    for n in (1 << 17, 1 << 20):
        began = time.process_time()
        own.merge([text(n).encode()])
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1


def test_rank_queue_pops_lowest_first():
    r, q = random.Random(0), bpe.RankQueue(50_000)
    ranks = [r.randrange(50_000) for _ in range(500)]
    for i, x in enumerate(ranks):
        q.push(x, np.array([i]))
    popped = []
    while (x := q.pop()) is not None:
        popped.append(x[0])
    assert popped == sorted(set(ranks))


def test_license_scan(spark):
    cases = [
        (1, "Released under the MIT License."), (2, "xx Licensed under the Apache License, Version 2.0. cc-by-nc; CC BY NC"), (3, None), (4, "under the mit"), (5, "under\nthe\nMIT é license"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "w " * 4000 + "cc by nc"), (8, ""),
    ]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(cases, "doc_id long, text string").withColumn("score", F.lit("x"))).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for d, t in cases:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        x = got[d]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(hits), ",".join(sorted({h[1] for h in hits})))
        assert (x.first_word, x.last_word) == (min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert 0 <= x.score <= 1
    assert got[6].labels == "gpl-3" and got[1].labels == "mit"
    assert got[3].score == 0 and got[8].score == 0 and 0.5 < got[4].score < 1 and got[4].labels == ""
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_license_notices_as_printed(spark):
    """Whole notices among other words, with some words changed; a notice without its key phrases is none; repeated rows."""
    notices = [t for t in license_scan.TEMPLATES if len(t.text.split()) > 30]
    assert len(notices) >= 6
    rows = []
    for i, t in enumerate(notices):
        words = t.text.split()
        free = [j for j, must in enumerate(license_scan.Index((t,)).keys[0]) if not must]
        changed = list(words)
        for j in free[:: max(6, len(free) // 4)]:
            changed[j] = "xxx"
        broken = [w if j in set(free) else "yyy" for j, w in enumerate(words)]
        rows += [(3 * i, "// before\n" + " ".join(w.upper() for w in words) + " after"), (3 * i + 1, "before " + ", ".join(changed)), (3 * i + 2, " ".join(broken))]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()}
    for i, t in enumerate(notices):
        long = [m for m in got[3 * i].matches if m.stop - m.start == len(t.text.split())]
        assert t.label in got[3 * i].labels.split(",") and [(m.label, m.start, m.share) for m in long] == [(t.label, 1, pytest.approx(1.0))]
        assert any(m.label == t.label and m.start == 1 for m in got[3 * i + 1].matches)
        assert not any(m.stop - m.start == len(t.text.split()) for m in got[3 * i + 2].matches)


def test_contained_items(spark):
    r = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 60)))) for i in range(20)]
    docs = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 300))]
        part = items[i % 20][1].split()
        cut = r.choice([0, 0, 1, 3, len(part) // 2])
        docs.append((i, " ".join([*w, *part[: len(part) - cut], *w[:5]]).upper() if i % 2 else " ".join(w)))
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1])]
    want = {}
    for d, t in docs:
        have = shingled(t, 5) if len((t or "").split()) >= 5 else set()
        for i, x in items:
            need = shingled(x, 5) if len(x.split()) >= 5 else set()
            if need and 10 * len(have & need) >= 8 * len(need):
                want[d, i] = (len(need), len(have & need))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_shared) for x in decontaminate.contained(frame, bench).collect()}
    assert got == want and want
    left = {x.doc_id for x in decontaminate.decontaminate(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == len(docs)


def test_fingerprints(spark, docs, rows):
    got = {x.doc_id: x.sketch for x in sketch.fingerprint(docs.withColumn("sketch", F.lit(1))).collect()}
    by_text = defaultdict(set)
    for d, t, *_ in rows:
        by_text[t or ""].add(tuple(got[d]))
    assert all(len(x) == 1 for x in by_text.values())
    long = [(d, t) for d, t, *_ in rows if t and len(t.split()) > 80]
    for (a, s), (b, t) in zip(long, long[1:]):
        x, y = shingled(s, 5), shingled(t, 5)
        assert abs(sketch.likeness(np.array(got[a]), np.array(got[b])) - len(x & y) / len(x | y)) < 0.5
    both = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5]), ([], [1])], "a array<long>, b array<long>")
    assert [tuple(x) for x in both.select(sketch.containment("a", "b"), sketch.merged("a", "b")).collect()] == [(0.5, [1, 2, 3, 4, 5]), (None, [1])]


def test_op5_neighbours(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in sketch.op5_document_fingerprints(spark, str(tmp_path)).collect()}
    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: -x[0])
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        k = len(t) // 3
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest() and got[d].n_chars == len(t)
    sketch_of = lambda x: {x[i : i + 16] for i in range(0, len(x), 16)}

    def near(x, y, equal):
        return len(x & y) / len(x | y) if x | y else float(equal)

    for i, (d, t) in enumerate(ordered):
        follower, nxt = ordered[(i + 1) % len(ordered)]
        k = len(t) // 3
        own, edited = sketch_of(got[d].fingerprint), sketch_of(got[d].edited_fingerprint)
        assert got[d].near_edited == near(own, edited, t == t[: len(t) - k] + nxt[:k])
        assert got[d].near_next == near(own, sketch_of(got[follower].fingerprint), t == nxt)


def test_op5_sketches_are_the_small_hashes_of_shingles(spark):
    """A text's fingerprint is the union of those of its five-word pieces, each of one shingle."""
    r = random.Random(9)
    words = [f"w{r.randrange(60)}" for _ in range(400)]
    pieces = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    rows = [(0, " ".join(words)), *((i + 1, x) for i, x in enumerate(pieces)), (9999, None), (10000, ""), (None, "a b c d e f")]
    got = {x.doc_id: x.sketch for x in sketch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = [set(got[i + 1]) for i in range(len(pieces))]
    assert set(got[0]) == set().union(*parts) and all(len(p) <= 1 for p in parts) and got[9999] == got[10000] == []
    kept = len({pieces[i] for i, p in enumerate(parts) if p}) / len(set(pieces))
    assert abs(kept - 1 / sketch.ONE_OF) < 0.06


def test_op5_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, fingerprint string, _bucket int"
    spark.createDataFrame([(None, "x y z", "c", 1), (None, None, "c", 1), (1, "a", "c", 1), (1, "a", "c", 1), (2, "b " * 40_000, "c", 1)], kind).write.parquet(f"{tmp_path}/some/documents.parquet")
    assert sorted((x.doc_id or 0, x.n_chars) for x in sketch.op5_document_fingerprints(spark, f"{tmp_path}/some").collect()) == [(0, 0), (0, 5), (1, 1), (1, 1), (2, 80_000)]
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sketch.op5_document_fingerprints(spark, f"{tmp_path}/none").collect() == []


def test_quality_classifier(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 80))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    rows += [(500, None), (501, ""), (None, "some text")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (2, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(docs, ["doc_id"])
    model = quality.fit_on_labels(stats, marks)
    got = {x.doc_id: x.score for x in quality.score(stats, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    out = {x.doc_id for x in docs.where(quality.held_out()).collect()} - {None, 500, 501}
    assert np.mean([(got[i] >= quality.THRESHOLD) == (i % 4 != 0) for i in out]) > 0.95
    flat = quality.fit_on_labels(stats, marks.limit(0))
    assert {x.score for x in quality.score(stats, flat).collect()} == {0.5}


def test_url_rules_and_templates(spark):
    urls = [
        "http://WWW.Example.com/en/a?x#y", "https://example.com/en/1", "https://sub.example.com/en/", "http://shop.com/x", "http://shop.com", "http://a.net/es/1", "net/es/1", None, "http://b.net/fr/", "ftp://x.org/path", "http://notexample.com/en/1", "http://a://b/c",
    ]
    rules = dict((r, a) for a, r in url_filter.RULES)

    def expected(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fit, key=len, default=None)

    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("x"))
    got = {x.page_id: x for x in url_filter.filter_urls(frame).collect()}
    for i, u in enumerate(urls):
        host, path, rule = expected(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (rules[rule] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    bad = [(i, f"http://h.org/bad/{i}") for i in range(20)] + [(100 + i, f"http://h.org/fine/{i}") for i in range(20)]
    judged = url_filter.filter_urls(spark.createDataFrame(bad, "page_id long, url string"), rules=[("block", "h.org/bad/1"), ("allow", "h.org/fine/1")]).collect()
    assert {x.verdict for x in judged if "/bad/" in x.url} == {"block"} and {x.verdict for x in judged if "/fine/" in x.url} == {"allow"}
    assert url_filter.filter_urls(frame.limit(0)).collect() == []


def judged(urls, rules):
    """The verdict and purity of each (host, path) by the method, in plain Python."""
    action = {}
    for hp in set(urls):
        fit = [(len(rule), rule, a) for a, rule in rules if (hp[0] == rule.split("/", 1)[0] or hp[0].endswith("." + rule.split("/", 1)[0])) and hp[1].startswith("/" + rule.split("/", 1)[1])]
        action[hp] = max(fit)[2] if fit else None

    def shape(x):
        if re.fullmatch(r"\d{4}-\d\d-\d\d", x):
            return "{date}"
        if re.fullmatch(r"\d+", x):
            return "{n}"
        if m := re.fullmatch(r"\d+\.([A-Za-z]{1,5})", x):
            return "{n}." + m[1]
        return "{hex}" if re.fullmatch(r"[0-9a-fA-F]{8,}", x) else "{id}" if re.search(r"\d{3,}", x) else None

    n = {hp: urls.count(hp) for hp in action}
    tokens = {hp: [] for hp in action}
    for i in range(max(len(p.split("/")) for _, p in action)):
        values = defaultdict(lambda: defaultdict(int))
        parts = {hp: [x for x in hp[1].split("/") if x] for hp in action}
        for hp, own in parts.items():
            if len(own) > i and shape(own[i]) is None:
                values[hp[0], tuple(tokens[hp])][own[i]] += n[hp]
        wild = {k for k, v in values.items() if len(v) > 12 and len(v) > 0.05 * sum(v.values())}
        for hp, own in parts.items():
            if len(own) > i:
                tokens[hp] = [*tokens[hp], shape(own[i]) or ("*" if (hp[0], tuple(tokens[hp])) in wild else own[i])]
    total = defaultdict(lambda: [0, 0])
    own, family = {}, {}
    for hp, t in tokens.items():
        literal = [i for i, x in enumerate(t) if not (x.startswith("{") or x == "*")]
        own[hp] = (hp[0], "/".join(t))
        family[hp] = (hp[0], "/".join("*" if literal and i == literal[-1] else x for i, x in enumerate(t)))
        for key in (("own", family[hp], own[hp]), ("family", family[hp]), ("host", hp[0]), ("all",)):
            total[key][0] += n[hp] * (action[hp] == "block")
            total[key][1] += n[hp] * (action[hp] is not None)
    smooth = lambda key, above: (total[key][0] + 4.0 * above) / (total[key][1] + 4.0)
    merged, groups = {}, defaultdict(lambda: [0, 0])
    for hp in tokens:
        (b, m), (fb, fm) = total["own", family[hp], own[hp]], total["family", family[hp]]
        share, every = (b + 0.5) / (m + 1), (fb + 0.5) / (fm + 1)
        alike = abs(share - every) <= 2.0 * (every * (1 - every) * (1 / (m + 1) + 1 / (fm + 1))) ** 0.5
        merged[hp] = (family[hp], family[hp] if alike else own[hp])
        groups[merged[hp]][0] += n[hp] * (action[hp] == "block")
        groups[merged[hp]][1] += n[hp] * (action[hp] is not None)
    base = (total["all",][0] + 1) / (total["all",][1] + 2)
    out = {}
    for hp in tokens:
        fam, template = merged[hp]
        host = smooth(("host", hp[0]), base)
        level = host if template == fam else smooth(("family", fam), host)
        purity = (groups[merged[hp]][0] + 4.0 * level) / (groups[merged[hp]][1] + 4.0)
        out[hp] = (action[hp] or ("block" if purity >= 0.5 else "allow"), purity)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_url_templates_by_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = [f"h{i}.{z}" for i in range(4) for z in ("org", "net")]
    bits = ["news", "shop", "a", "b", "2024-01-02", "77", "7.html", "deadbeef99", "x123y"]
    urls = []
    for _ in range(900):
        path = [r.choice(bits) if r.random() < 0.8 else "".join(r.choice("pqrs") for _ in range(3)) for _ in range(r.randint(0, 4))]
        urls.append((r.choice(hosts), "/" + "/".join(path)))
    urls += r.choices(urls, k=200)
    rules = [("block", "net/news/"), ("allow", "h1.net/news/a"), ("allow", "org/shop/"), ("block", "h2.org/a/"), ("allow", "h3.org/")]
    frame = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x for x in url_filter.filter_urls(frame, rules=rules).collect()}
    want = judged(urls, rules)
    assert len(got) == len(urls) and {v for v, _ in want.values()} == {"allow", "block"}
    for i, hp in enumerate(urls):
        assert (got[i].host, got[i].path) == hp and got[i].verdict == want[hp][0]
        assert abs(got[i].purity - want[hp][1]) < 1e-9


def test_url_templates_without_labels(spark):
    """Unlabelled branches take the purity of their family or host, and places below a wildcard are one place."""
    urls = [f"http://bad.org/{a}/p{i}" for a in ("x", "y", "z") for i in range(4)] + [f"http://good.org/{a}/p{i}" for a in ("x", "y", "z") for i in range(4)]
    urls += [f"http://deep.org/{i % 16}000/{chr(97 + i)}q/end" for i in range(16)] + [f"http://wide.org/{chr(97 + i)}/{chr(97 + i)}r/end" for i in range(16)]
    rules = [("block", "bad.org/x/"), ("block", "bad.org/y/"), ("allow", "good.org/x/"), ("allow", "good.org/y/")]
    got = {x.url: x for x in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert len(got) == len(urls)
    assert {got[f"http://bad.org/z/p{i}"].verdict for i in range(4)} == {"block"} and {got[f"http://good.org/z/p{i}"].verdict for i in range(4)} == {"allow"}
    assert len({x.template for x in got.values() if x.host == "deep.org"}) == 1 and len({x.template for x in got.values() if x.host == "wide.org"}) == 1


FOLLOWS = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool"}, "tool": {"assistant"}}
KNOWN = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "function": "tool", **{r: r for r in ("system", "user", "assistant", "tool")}}
TO_END = {"start": 0, "system": 6, "user": 3, "assistant": 0, "tool": 3}  # empty turns until an assistant's


def cheapest(roles):
    best = {"start": 0}
    for role in roles:
        own = KNOWN.get((role or "").strip().lower())
        reach = dict(best)
        for _ in range(5):
            for s, cost in list(reach.items()):
                for t in FOLLOWS[s]:
                    reach[t] = min(reach.get(t, 1 << 30), cost + 3)
        after = {}
        for s, cost in reach.items():
            for t in ("system", "user", "assistant", "tool"):
                label = 0 if t == own else 2 if own else 1
                if t in FOLLOWS[s]:
                    after[t] = min(after.get(t, 1 << 30), cost + label)
                if t == s:
                    after[t] = min(after.get(t, 1 << 30), cost + label + 1)
        best = after
    return min(cost + TO_END[s] for s, cost in best.items())


def test_role_repair_is_cheapest():
    r = random.Random(0)
    for _ in range(800):
        roles = [r.choice(["user", "assistant", "system", "tool", None, "x", "human"]) for _ in range(r.randrange(9))]
        state, cost = "start", 0
        for i, new, action, _, _ in chat.repair(roles, ["t"] * len(roles)):
            own = chat._role(roles[i]) if i is not None else new
            cost += chat.INSERT if action == "insert" else 0 if own == new else chat.RELABEL if own else chat.RELABEL_UNKNOWN
            cost += chat.MERGE if action == "merge" else 0
            assert new == state if action == "merge" else new in chat.LEGAL[state]
            state = new
        assert state in ("assistant", "start") and cost == cheapest(roles)


def test_chats_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, "x"]), r.choice(["a", "b", "", None])) for c in (1, 2, None) for t in range(30)]
    rows += [(3, None, "user", "x"), (3, 0, "user", "y"), (3, 0, "user", "y")]
    got = defaultdict(list)
    for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[x.conv_id].append(x)
    for c in (1, 2, None, 3):
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        parts = sorted(got[c], key=lambda x: (x.chunk, x.position))
        assert [(x.role, x.text) for x in parts if x.action != "insert"] == [(x[2], x[3] or "") for x in own]
        text = "".join(x.rendered for x in parts)
        assert text.count("<|end|>") == sum(x.action != "merge" for x in parts) and text.endswith("<|end|>\n")
        state, cost = "start", 0
        for x in parts:
            own_role = chat._role(x.role) if x.action != "insert" else x.new_role
            cost += chat.INSERT if x.action == "insert" else 0 if own_role == x.new_role else chat.RELABEL if own_role else chat.RELABEL_UNKNOWN
            cost += chat.MERGE if x.action == "merge" else 0
            assert x.new_role == state if x.action == "merge" else x.new_role in chat.LEGAL[state]
            state = x.new_role
        assert cost == cheapest([x[2] for x in own])
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_warc_records(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><p>One <b>two</b></p><script>x("</p>")</script><a href="/a?x=1&amp;y=2">link</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://x.org/", html), (2, None, None)], "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    made = warc.responses(pages)
    got = {(x.page_id, x.record_type): x for x in warc.derive(made).collect()}
    source = {x.page_id: x for x in made.collect()}
    text, meta = got[1, "conversion"], got[1, "metadata"]
    assert text.body == "One two\nlink" and meta.body == "title: A & B\r\nlanguage: en\r\noutlink: /a?x=1&y=2 L a/@href\r\n"
    for x in (text, meta):
        assert x.refers_to == source[1].record_id and x.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert x.block_digest == "sha256:" + hashlib.sha256(x.body.encode()).hexdigest() and x.content_length == len(x.body.encode())
        assert f"WARC-Refers-To: {x.refers_to}\r\n" in x.record and x.record.endswith(f"\r\n\r\n{x.body}\r\n\r\n")
    assert got[2, "conversion"].body == "" and text.record_id != meta.record_id
    assert f"X-Source-Status: HTTP/1.1 200 OK\r\nX-Source-Content-Type: text/html; charset=utf-8\r\nX-Source-Content-Length: {len(html)}\r\n\r\n" in text.record and text.source_headers == source[1].http_headers


def test_warc_source_headers_and_odd_tables(spark):
    headers = "HTTP/1.1 404 Not Found\r\nServer: x\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n"
    made = warc.responses(spark.createDataFrame([(1, "u", "<p>" + "word " * 60_000), (1, "u", "<p>" + "word " * 60_000), (2, "v", "")], "page_id long, url string, html string"))
    given = made.withColumn("http_headers", F.when(F.col("page_id") == 1, headers))
    rows = warc.derive(given).collect()
    assert len(rows) == 6
    for x in rows:
        block = x.record.split("\r\n\r\n", 1)[0]
        assert ("X-Source-Status: HTTP/1.1 404 Not Found\r\nX-Source-Server: x\r\nX-Source-Set-Cookie: a=1\r\nX-Source-Set-Cookie: b=2" in block) == (x.page_id == 1)
        assert (x.source_headers is None) == (x.page_id == 2) and f"Content-Length: {len(x.body.encode())}" in block
    assert warc.derive(made.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ("<script>", "<style x ", "<!-- ", "<head>", "<p ", "<div>", "<title>", "<title ", "<html ", "<a ", '<a href="', "<", "</script ", "&"))
def test_warc_reads_unclosed_tags_once(spark, unit):
    page = spark.createDataFrame([(1, "http://a/", unit * (1_000_000 // len(unit)))], "page_id long, url string, html string")
    begin = time.time()
    kinds = {x.record_type: x.body for x in warc.derive(warc.responses(page)).collect()}
    assert time.time() - begin < 20
    assert kinds["metadata"].startswith("title: \r\nlanguage: \r\n")


def test_warc_unclosed_tags_stay(spark):
    page = "<html lang='x'><script>gone</script>a<br>b <script async> stays <b>bold</b> 1 < 2 <p open"
    body = {x.record_type: x.body for x in warc.derive(warc.responses(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string"))).collect()}
    assert body["conversion"] == "a\nb stays bold 1 < 2"
