"""Periodic runs, cross-tokenizer alignment and quality rules against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import alignment, periodic, quality, quality_rules

DOCS = "doc_id long, text string, source string"


def runs_of(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 4)):
            k = r.choice([1, 2, 2, 3, 5, 40])
            w = [r.randint(0, k) for _ in range(r.randint(0, 60))]
            if r.random() < 0.6:
                b = [r.randint(0, k) for _ in range(r.randint(1, 12))]
                at = r.randint(0, len(w))
                w[at:at] = (b * 10)[: r.randint(1, 60)]
            docs.append(w)
        word = np.array([x for d in docs for x in d], np.int64)
        base = np.cumsum([0] + [len(d) for d in docs])
        want = [(s + base[i], e + base[i], q) for i, d in enumerate(docs) for s, e, q in runs_of(d)]
        for rounds in (0, 1, 40):  # the splitting saves work and changes nothing
            assert list(zip(*(x.tolist() for x in periodic.find_runs(word, np.repeat(np.arange(len(docs)), np.diff(base)), rounds=rounds)))) == want


def test_prose_falls_apart():
    r = random.Random(1)
    words = np.array([int(2000 * r.random() ** 3) for _ in range(5000)])
    at, _ = periodic.split_by_frequency(words, np.zeros(len(words), np.int64), 12)
    assert len(at) <= 5000
    chain = np.array([x for i in range(3000) for x in (i + 2, i)])  # loses a word at its end in each round
    assert [x.tolist() for x in periodic.find_runs(chain, np.zeros(len(chain), np.int64))] == [[], [], []]


@pytest.mark.parametrize("words", ([0] * 100_000, list(range(500)) * 200, [bin(i).count("1") % 2 for i in range(1 << 16)]))
def test_long_runs(words):
    start, stop, period = periodic.find_runs(np.array(words), np.zeros(len(words), np.int64))
    assert (stop - start >= np.maximum(12, 2 * period)).all()
    if len(words) == 100_000:
        assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [100_000], [len(set(words))])


def odd_docs():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgé漢 ") for _ in range(r.randint(1, 6))) for _ in range(80)]
    out = []
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if i % 4 == 0:
            w[5:5] = (w[:7] * 9)[: r.randint(10, 60)]
        out.append((i, (" " if i % 3 else "\t\n ").join(w), "s"))
    return out + [(150, None, "s"), (151, "", None), (None, "a " * 40, "s"), (152, " \n", "s"), (153, "w " * 5000, "s"), (153, "w " * 5000, "s"), (-7, "x y " * 9, "s")]


def brute_op12(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(w) if n < 1000 else [(0, n, 1)]
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    line = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (len(runs), *line, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def written(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, DOCS).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_op12_by_brute_force(spark, tmp_path):
    rows = odd_docs()
    got = periodic.op12_periodic_runs(spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert Counter(map(tuple, got.collect())) == Counter((d, *brute_op12(d, t)) for d, t, _ in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 5


def test_periodic_runs_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 10, 5)], "runs long, text string, collapsed long")
    got = periodic.periodic_runs(docs).collect()
    assert [(x.text, x.n_words, [tuple(r) for r in x.runs], x.collapsed) for x in got] == [("a b " * 10, 20, [(0, 20, 2)], "a b")]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers as P

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    with open(paths[0], "rb") as a, open(paths[1], "rb") as b:
        return paths, alignment.ByteLevel(a.read()), alignment.Pieces(b.read())


def brute_alignment(text, sides):
    _, a, b = sides
    if not text:
        return [], []
    out = []
    for side, whole in ((a, a.tokenizer.encode(" " + text, add_special_tokens=False).ids), (b, b.model.encode(text))):
        ids, end, rows = whole, 0, []
        for i in ids:
            end += len(side.tokens[i].as_py())
            rows.append((i, end))
        if b"".join(side.tokens[i].as_py() for i in ids) != (" " + text).encode():
            return [], []
        out.append(rows)
    return out


def test_op11_by_brute_force(spark, tmp_path, sides):
    r = random.Random(3)
    base = ["Hello world", "The quick brown fox", "naïve café", "漢字かな交じり文", "a▁b", "<|endoftext|> and <s> </s> <unk>", "\x00\x01", "🙂🙃 mixed", "  two  spaces ", "\n\n\tx", "aaaa" * 500, "ᚠᛇ rune", "don't we'll"]
    rows = [(i, " ".join(r.choice(base) for _ in range(r.randint(1, 30))) if i % 2 else r.choice(base), "s") for i in range(80)]
    rows += [(80, None, None), (81, "", "s"), (82, " ", "s"), (None, "Hello world", "s"), (5, "Hello world", "s"), (83, "word " * 20_000, "s")]
    got = alignment.op11_cross_tokenizer_alignment(spark, written(spark, tmp_path, rows))
    sides_of = [brute_alignment(t, sides) for _, t, _ in rows]
    links = []
    for a, b in sides_of:
        at: dict[int, list[int]] = {}
        for y, f in b:
            at.setdefault(f, []).append(y)
        links.append([(x, y) for x, e in a for y in at.get(e, [])])
    counts = Counter(x for l in links for x in l)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for (d, *_), (a, b), l in zip(rows, sides_of, links):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        low, parts = 0, []
        for c in cuts:
            parts.append("|".join(",".join(str(x) for x, e in s if low < e <= c) for s in (a, b))) if len(a) < 2000 else None
            low = c
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        want.append((d, len(a), len(b), len(cuts), len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), sha if len(a) < 2000 else None))
    got = Counter((*tuple(x)[:7], x.groups_sha256 if x.n_a < 2000 else None) for x in got.collect())
    assert got == Counter(want)
    assert sum(w[1] == 0 for w in want) > 3 and any(w[3] for w in want)


def test_alignment_blocks_and_columns(spark, sides):
    (path_a, path_b), a, b = sides
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * (i % 5), 1, "z") for i in range(60)], "doc_id long, text string, links long, groups string").repartition(2)
    rows = alignment.aligned(docs, path_a, path_b, block_bytes=100)
    assert rows.select("_block").distinct().count() > 10 and "text" not in rows.columns
    one = alignment.with_counts(rows, len(a), len(b))
    whole = alignment.with_counts(alignment.aligned(docs, path_a, path_b), len(a), len(b))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, whole.select(*one.columns).collect()))
    assert alignment.with_counts(alignment.aligned(docs.limit(0), path_a, path_b), len(a), len(b)).collect() == []
    text = {x.doc_id: x.groups for x in one.where(F.col("doc_id") < 2).collect()}
    assert text[0] == "" and text[1].count(";") == text[1].count("|") - 1 > 0


def measures_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_by_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        w = [r.choice(["a", "bé", "漢字", "#x", "<b>", "it", "$5|"]) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            w += w[: r.randint(0, 40)] + ["z"] + w[3:20]
        rows.append((i, "".join(x + r.choice([" ", "\n", "\n", "\t", " \n\n"]) for x in w), i))
    rows += [(120, None, 1), (121, "", 1), (122, "\n \n", 1), (123, "same line here\n" * 4000, 1), (None, "x " * 8, 1), (124, "x " * 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = quality_rules.measured(docs)
    assert got.columns == ["doc_id", "text", *quality_rules.MEASURES]
    assert Counter(map(tuple, got.drop("text").collect())) == Counter((d, *measures_of(t)) for d, t, _ in rows)
    assert quality_rules.measured(docs.limit(0)).collect() == []


def test_binomial_bounds(spark):
    cases = [(k, n, p) for n in (0, 1, 5, 89, 90, 500, 20_000) for k in {0, 1, n // 50, n // 25} if k <= n for p in (0.05,)]

    def exact(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    rows = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long").select("k", "n", quality_rules.binomial_below(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for x in rows:
        assert x.p == pytest.approx(1 if x.k > x.n * 0.05 else exact(x.k, x.n, 0.05), rel=1e-9)


def judge_by_brute_force(rows, labels):
    """rows: (doc_id, text, lang); kept of each row in turn."""
    q = quality_rules
    grids = [q.grid(a, b) for _, _, _, a, b in q.RULES]
    all_measures = [dict(zip(q.MEASURES, measures_of(t))) for _, t, _ in rows]
    failed = [m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] for m in all_measures]
    broken = lambda m, rule, c: (rule[2] * m[rule[0]] > c * m[rule[1]]) if rule[4] > 0 else (rule[2] * m[rule[0]] < c * m[rule[1]])
    stratum = [lang if lang in q.STRATA else "other" for _, _, lang in rows]
    known = {s: ([], []) for s in set(stratum)}
    for (d, *_), m, f, s in zip(rows, all_measures, failed, stratum):
        for y in {y for x, y in labels if x == d and x is not None and y in (0, 1)}:
            if not f:
                known[s][int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) % 5 != 0].append((m, y))
    cuts = {}
    for s, (tune, hold) in known.items():
        tuned = []
        for rule, cutoffs in zip(q.RULES, grids):
            gain, at = max((sum((1 if y == 0 else -q.COST) for m, y in tune if broken(m, rule, c)), i) for i, c in enumerate(cutoffs))
            tuned.append(at if gain > 0 else None)
        good = [m for m, y in hold if y == 1]
        reject = lambda m, level, tuned=tuned: any(i is not None and i + level < q.STEPS and broken(m, rule, g[i + level]) for rule, g, i in zip(q.RULES, grids, tuned))
        used = None
        for level in reversed(range(q.LEVELS)):
            k, n = sum(reject(m, level) for m in good), len(good)
            p = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
            if not tune or k > 0.05 * n or p > 0.05 / 5:
                break
            used = level
        cuts[s] = (reject, used)
    return [not f and not (cuts[s][1] is not None and cuts[s][0](m, cuts[s][1])) for m, f, s in zip(all_measures, failed, stratum)]


def labelled_docs(seed, n=900):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8) if good or r.random() < 0.4 else r.randint(7, 14))) for _ in range(r.randint(15, 40))]
        if not good and r.random() < 0.6 or r.random() < 0.02:
            words = [w + r.choice(["|", "#", "<>", ""]) for w in words]
        rows.append((i, r.choice([" ", "\n"]).join(words), r.choice(["en", "en", "fr", "xx", None])))
        if r.random() < 0.9:
            labels.append((i, int(good)))
    rows += [(None, "a " * 30, "en"), (n, None, "en"), (5, rows[5][1], "fr"), (n + 1, "", "fr")]
    labels += [(None, 0), (3, None), (4, 7), (6, 0), (6, 1), (8, labels[3][1]), (10**9, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", (1, 2))
def test_judged_by_brute_force(spark, seed):
    rows, labels = labelled_docs(seed)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, lang string, fired long, kept long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality long")
    got = quality_rules.judged(docs, marks)
    want = judge_by_brute_force(rows, labels)
    assert Counter((x.doc_id, x.n_words, x.kept) for x in got.collect()) == Counter((d, measures_of(t)[0], k) for (d, t, _), k in zip(rows, want))
    assert 0.6 < sum(want) / len(want) < 0.97 and got.where("not kept and not base_failed").count() > 20
    none = quality_rules.judged(docs, marks.limit(0))
    assert none.where("kept = base_failed").count() == 0, "without labels only the base drops"
    assert quality_rules.judged(docs.limit(0), marks).collect() == []


def test_rules_bound_false_rejections(spark):
    """Where labels say nothing about the text, no cutoff may drop more than the bound of good texts."""
    r = random.Random(7)
    rows, _ = labelled_docs(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(r.random() < 0.9)) for i in range(900)], "doc_id long, quality long")
    got = quality_rules.judged(docs, marks).where("not base_failed").agg(F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert got.kept >= 0.9


def statistics_of(text):
    t = (text or "").encode()
    words = t.split()
    lines = [x for x in t.split(b"\n") if x]
    kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?-'\"()", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "line": b"\n", "blank": b" \t\r"}
    size, n = max(len(t), 1), max(len(words), 1)
    shares = [math.sqrt(sum(c in chars for c in t) / size) for chars in kinds.values()] + [math.sqrt(sum(c >= 0x80 for c in t) / size)]
    odd = kinds["bang"] + kinds["bar"] + kinds["symbol"]
    return [
        *shares,
        math.log1p(len(t)),
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        len(set(words)) / n,
        math.sqrt(max(Counter(words).values(), default=0) / n),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 4)),
        math.sqrt(sum(w[-1] in odd for w in words) / n),
        math.sqrt(sum(w[0] in kinds["upper"] for w in words) / n),
        sum(len(w) <= 3 for w in words) / n,
        math.log1p(len(words) / (1 + sum(w[-1:] in b".?!" for w in words))),
    ]


def scores_by_definition(rows, labels):
    """Scores of a discriminant with shrunk covariances, from its densities."""
    x = {d: np.array(statistics_of(t)) for d, t, *_ in rows}
    learn = [(d, y) for d, y in labels if y in (0, 1) and d in x and zlib.crc32(str(d).encode()) % 5]
    matrix, y = np.array([x[d] for d, _ in learn]), np.array([y for _, y in learn])
    mean, scale = matrix.mean(axis=0), matrix.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (matrix - mean) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(np.mean(y == k) * covs[k] for k in (0, 1))
    out = {}
    for d, row in x.items():
        logs = []
        for k in (0, 1):
            cov = 0.8 * covs[k] + 0.1 * pooled + (0.1 + 1e-9) * np.eye(len(mean))
            diff = (row - mean) / scale - z[y == k].mean(axis=0)
            logs.append(math.log(np.mean(y == k)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * diff @ np.linalg.solve(cov, diff))
        out[d] = 1 / (1 + math.exp(min(60, max(-60, logs[0] - logs[1]))))
    return out


def test_op10_by_definition(spark, tmp_path):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcDé9") for _ in range(r.randint(1, 9))) + (r.choice(["", "!", "|", "#"]) if not good else r.choice(["", "", "."])) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w), "s"))
        if r.random() < 0.8:
            labels.append((i, int(good)))
    rows += [(300, None, "s"), (301, "", None), (302, "x" * 50_000, "s"), (303, "same\n" * 2000, "s")]
    labels += [(3, 1), (4, None), (5, 7), (999, 1)]
    folder = written(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    got = quality.op10_quality_classifier(spark, folder).collect()
    want = scores_by_definition(rows, labels)
    assert {x.doc_id: x.score for x in got} == pytest.approx(want, abs=1e-6)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == (x.score >= 0.3) for x in got)
    empty = tmp_path / "empty"
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert quality.op10_quality_classifier(spark, str(empty)).collect() == []
