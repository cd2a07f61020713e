"""License scans: a positional rare-token index.

A first pass counts over all documents in how many each licence word stands, which gives the words' IDF. In the scan the
licence words of a file are looked up by falling IDF: the templates whose rarest mandatory word it is are tried where it
stands, and the postings of their other words are intersected by their place relative to that word. The IDF-weighted
share in place scores a match; from MATCH on, the mandatory key phrases must stand word for word at their places.

Base phrases are templates whose key phrase is the whole text, so every place where they stand is found.

Defined results: a null text counts as empty; without a match labels are empty strings and places null. The score is the
largest share of a template in place, whether or not it is a match, and 0 if no template has over half in place.
Other columns pass unchanged; columns named like the operator's own are replaced. Memory: a few MB of texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._memory import tidy
from ._words import NOT_ALNUM, Words, chunks, texts_of

MATCH = 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases of the text that must stand in place
    base: bool = False


def _whole(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base)


def _notice(label: str, text: str, *keys: str) -> Template:
    """A longer notice, as it is printed."""
    plain = lambda x: " ".join(re.findall("[a-z0-9]+", x.lower()))
    return Template(label, plain(text), tuple(map(plain, keys)))


# The phrases that the scan must label, then those of its own.
TEMPLATES = (
    _whole("mit", "under the mit license", True),
    _whole("apache-2", "apache license version 2", True),
    _whole("cc-by-nc", "cc by nc", True),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge to any person obtaining a copy",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    _notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "to deal in the software without restriction",
        "the software is provided as is",
    ),
    _notice(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "you may not use this file except in compliance with the license",
    ),
    _notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    _notice(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    _notice(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    _notice(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "to alter it and redistribute it freely",
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

_OUT = {
    "n_words": T.LongType(),
    "n_base": T.LongType(),
    "first_word": T.LongType(),
    "last_word": T.LongType(),
    "base_labels": T.StringType(),
    "labels": T.StringType(),
    "score": T.DoubleType(),
    "matches": T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("share", T.DoubleType())])),
}
_MATCH_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))


class Index:
    """The words of the templates, as codes by their hashes, and the templates as codes."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.names = sorted({w for t in templates for w in t.text.split()})
        hashes = Words([" ".join(self.names).encode()], NOT_ALNUM, True).hashes
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(self.names)}
        self.codes = [np.array([number[w] for w in t.text.split()]) for t in templates]
        self.keys = []
        for t, codes in zip(templates, self.codes):
            must = np.zeros(len(codes), bool)
            for phrase in t.keys:
                words = phrase.split()
                at = next(i for i in range(len(codes)) if t.text.split()[i : i + len(words)] == words)
                must[at : at + len(words)] = True
            self.keys.append(must)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each licence word; counted over all documents."""
    index = Index(templates)
    n = len(index.names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(text))
            counts[n] += len(texts)
            for a, b in chunks(texts):
                words = Words(texts[a:b], NOT_ALNUM, True)
                code = index.code(words.hashes)
                has = np.flatnonzero(code >= 0)
                counts[:n] += np.bincount(np.unique(words.text_of_word()[has] * n + code[has]) % n, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1), pa.int32()), pa.array(counts)], ["word", "docs"])

    rows = docs.select(text).mapInArrow(run, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    found = {r["word"]: r["docs"] for r in rows}
    return found.get(n, 0), {w: found.get(i, 0) for i, w in enumerate(index.names)}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs with n_words; n_base, first_word, last_word and base_labels of the base phrases; labels, score and matches of all."""
    index = Index(templates)
    total, frequencies = word_frequencies(docs, templates, text)
    idf = np.array([np.log((1 + total) / (1 + frequencies[w])) + 1 for w in index.names])
    anchored: dict[int, list[tuple]] = defaultdict(list)
    for t, own, must in zip(templates, index.codes, index.keys):
        rare = int(np.argmax(np.where(must, idf[own], -1)))
        anchored[int(own[rare])].append((t, own, must, rare))
    names = [c for c in docs.columns if c not in _OUT]
    schema = T.StructType([*docs.select(*names).schema.fields, *(T.StructField(k, v) for k, v in _OUT.items())])

    def find(texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple]]]:
        words = Words(texts, NOT_ALNUM, True)
        code = index.code(words.hashes)
        postings = np.flatnonzero(code >= 0)
        by_word = {int(c): postings[code[postings] == c] for c in np.unique(code[postings])}
        owner = np.searchsorted(words.first, postings, "right") - 1
        of = dict(zip(postings.tolist(), owner.tolist()))
        found: list[list[tuple]] = [[] for _ in texts]
        for word, (t, own, must, rare) in ((w, x) for w in sorted(by_word, key=lambda w: -idf[w]) for x in anchored.get(w, ())):
            at, weight = by_word[word], idf[own] / idf[own].sum()
            text_at = np.array([of[p] for p in at.tolist()])
            lo, hi = words.first[text_at], words.first[text_at + 1]
            share, keys = np.zeros(len(at)), np.ones(len(at), bool)
            for j, c in enumerate(own):
                place = at + (j - rare)
                inside = (place >= lo) & (place < hi)
                hit = inside & (code[np.clip(place, 0, len(code) - 1)] == c)
                share += weight[j] * hit
                if must[j]:
                    keys &= hit
            for i in np.flatnonzero(share > 0.5):
                start = int(at[i] - rare - lo[i])
                found[text_at[i]].append((t, start, start + len(own), float(min(share[i], 1.0)), bool(keys[i]) and share[i] >= MATCH))
        return words.counts(), found

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunks(texts):
                counts, found = find(texts[a:b])
                base = [[m for m in x if m[0].base and m[4]] for x in found]
                good = [[m for m in x if m[4]] for x in found]
                label = lambda x: ",".join(sorted({m[0].label for m in x}))
                out = [
                    pa.array(counts, pa.int64()),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min((m[1] for m in x), default=None) for x in base], pa.int64()),
                    pa.array([max((m[1] for m in x), default=None) for x in base], pa.int64()),
                    pa.array([label(x) for x in base], pa.string()),
                    pa.array([label(x) for x in good], pa.string()),
                    pa.array([max((m[3] for m in x), default=0.0) for x in found], pa.float64()),
                    pa.array([[{"label": m[0].label, "start": m[1], "stop": m[2], "share": m[3]} for m in x] for x in good], _MATCH_TYPE),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(names).columns, *out], [*names, *_OUT])

    return docs.mapInArrow(run, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "matches")
