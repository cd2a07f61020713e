"""What the tokenizer holds while it works."""

from __future__ import annotations

import tracemalloc

import public_tokenizers

from strandlog.llm import bpe
from strandlog.llm._words import chunks


def test_memory_of_many_distinct_pieces():
    """Chunks of 2 MB and 400,000 remembered pieces took 167 MB here, in each worker."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        v = bpe.vocabulary(f.read())
    words = [f" w{i * 7919 % 1000003:x}q" for i in range(300_000)]
    texts = ["".join(words[i : i + 300]).encode() for i in range(0, len(words), 300)]
    v.forget()
    tracemalloc.start()
    try:
        ids = [x for a, b in chunks(texts, bpe.CHUNK_BYTES) for x in v.encode(texts[a:b])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        v.forget()
    assert [b"".join(v.tokens[i] for i in x.tolist()) for x in ids] == texts
    assert peak < 80_000_000
