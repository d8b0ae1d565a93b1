"""The FM-index, and contamination by brute force."""

import random

import numpy as np
import pytest

from tidefold.llm import decontamination
from tidefold.llm.decontamination import contamination, decontaminated, words_of
from tidefold.llm.fm_index import FMIndex


@pytest.mark.parametrize("seed", range(40))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(2, 6))
    s = rng.integers(1, k, int(rng.integers(1, 60)))
    index = FMIndex(s, k, int(rng.integers(1, 5)))
    patterns = [rng.integers(1, k, int(rng.integers(1, 5))) for _ in range(8)]
    rows = np.zeros((8, 4), np.int64)
    for row, p in zip(rows, patterns, strict=True):
        row[4 - len(p) :] = p
    a, b = index.ranges(rows, np.array(list(map(len, patterns))))
    for i, p in enumerate(patterns):
        want = [j for j in range(len(s) - len(p) + 1) if (s[j : j + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a[i], b[i])).tolist()) == want


def brute(text, items, window):
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, x in items:
        x = words_of((x or "").encode())
        for i in range(max(1, len(x) - window + 1) if x else 0):
            w = x[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= {*range(j, j + len(w))}
                    found.add(item)
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)  # small blocks: several passes
    rnd = random.Random(4)
    make = lambda n: " ".join(rnd.choice("a b c d e f G É x1 -".split()) for _ in range(rnd.randint(0, n)))
    rows = [(k, make(60), "m") for k in range(60)] + [(60, None, "m"), (60, "", "m"), (None, "a b c d", "m")]
    items = [(str(k), make(7)) for k in range(6)] + [("6", None), ("0", "a b c d"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r.key, r.n_words, frozenset(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in contamination(docs, bench, window=4).collect()), key=str)
    known = [x for x in items if x[0] is not None]
    assert got == sorted(((k, *(lambda b: (b[0], frozenset(b[1]), tuple(b[2])))(brute(t, known, 4))) for k, t, _ in rows), key=str)
    clean = decontaminated(docs, bench, window=4)
    assert clean.schema == docs.schema
    for r in clean.collect():
        assert not brute(r.text, known, 4)[1]
    untouched = {(k, t) for k, t, _ in rows if not brute(t, known, 4)[1]}
    assert untouched <= {(r.doc_id, r.text) for r in clean.collect()}
    assert contamination(docs.limit(0), bench).collect() == []
    assert all(not r.spans for r in contamination(docs, bench.limit(0)).collect())
