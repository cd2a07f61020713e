"""The pipeline against its stages' brute-force meaning on a small table."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm import jaccard_join, quality


def write(spark, folder):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(r.randint(60, 120))]
        text = " ".join(w) + "."
        if i % 10 == 1:
            text = " ".join(x.upper() + "!!" for x in w)
        elif i % 10 == 2:
            text = f"{text} {items[i % 5][1]}"
        elif i % 10 == 3:
            text = rows[-3][1] + " end" if i > 10 else text
        elif i % 10 == 4:
            text = f"{text} {passage}"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 10 != 1), 0))
    rows.append((300, rows[0][1], "en", "s", rows[0][4]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, passage


def test_run(spark, tmp_path):
    rows, items, passage = write(spark, tmp_path)
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    text = {r[0]: r[1] for r in rows}
    assert not any(d % 10 == 1 for d in out), "rejected by the classifier"
    assert not any(item in x.text for x in out.values() for _, item in items), "contaminated"
    assert 300 not in out and not any(d % 10 == 3 and d > 10 for d in out), "near duplicates"
    assert sum(passage in x.text for x in out.values()) == 1, "a passage stays in its first document"
    clean = [d for d in text if d % 10 in (0, 5, 6, 7, 8, 9) and d < 300]
    assert all(d in out and out[d].text == text[d] and out[d].n_chars == len(text[d]) for d in clean)
    assert all(x.n_tokens > 0 for x in out.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring", "contamination", "tokens"]


def test_stages_return_documents(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_near_dedup_keeps_unlike_rows_of_one_id(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "a b c d e f g"), (7, "other words are in this one"), (7, ""), (7, ""), (7, None), (5, base + " y"), (5, base + " x"), (6, base + " z"), (None, base), (9, "alone"), (9, "alone")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    order = lambda x: (str(x[0]), str(x[1]))
    got = sorted(((x.doc_id, x.text) for x in jaccard_join.stage(spark, docs, str(tmp_path)).collect()), key=order)
    assert got == sorted([*rows[:5], (5, base + " x"), (None, base), (9, "alone")], key=order)


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, and columns with the names that the operators use."""
    write(spark, tmp_path)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    plain = [" ".join(word() for _ in range(80)) + "." for _ in range(4)]
    rows = [(None, plain[0]), (None, None), (1, None), (1, ""), (1, plain[1]), (1, plain[1]), (2, plain[2]), (2, plain[3]), (3, long), (4, long + " more"), (5, "   \n"), (6, "é漢 😀")]
    clash = ["score", "statistics", "component_id", "n_shingles", "_mark", "spans", "kept", "n_removed", "_block", "_row", "_words", "ids"]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in clash:
        docs = docs.withColumn(c, F.lit("x"))
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "tokens" or len(out.columns) == len(docs.columns))
        got[name] = out.collect()
        assert all(x[c] == "x" for x in got[name] for c in clash)
    assert {(x.doc_id, x.text) for x in got["quality"]} <= set(rows)
    near = sorted((str(x.doc_id), x.text or "") for x in got["near_dedup"])
    assert near == sorted((str(d), t or "") for d, t in [(None, plain[0]), (None, None), (1, None), (1, ""), (1, plain[1]), (2, plain[2]), (2, plain[3]), (3, long), (5, "   \n"), (6, "é漢 😀")])
    cut = {(x.doc_id, x.text) for x in got["substring"]}
    assert (4, "more") in cut and (3, long) in cut and len(got["substring"]) == len(rows) == len(got["contamination"]) == len(got["tokens"])


def test_statistics_are_finite():
    x = quality.statistics([b"", b"a", b"\n\n", b"word " * 100, "é漢 😀".encode()])
    assert x.shape == (5, len(quality.FEATURES)) and np.isfinite(x).all()
