"""Shingle similarity against brute force."""

import random

from tidefold.llm.shingle_sets import similar_documents


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    of = {k: k for k in texts}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    sets = {k: shingles(t) for k, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def corpus():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(20)]
    texts = {0: None, 1: "", 2: "one two", 3: "ONE  two", 4: "one two three"}
    for _ in range(12):
        w = [rnd.choice(words) for _ in range(rnd.randint(8, 150))]
        for _ in range(rnd.randint(1, 8)):
            texts[len(texts)] = " ".join(w)
            for _ in range(rnd.randint(0, 3)):
                w = w[:]
                w[rnd.randrange(len(w))] = rnd.choice(words)
    for _ in range(40):
        texts[len(texts)] = " ".join([*passage, *(rnd.choice(words) for _ in range(rnd.randint(0, 12)))])
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([*texts.items(), (None, "one two")], "doc_id bigint, text string").repartition(4)
    want = components(texts)
    got = {r.key: r.component for r in similar_documents(df).collect()}
    assert got == want and len(set(want.values())) < len(want)
    assert similar_documents(df.limit(0)).collect() == []


def test_stage_removes_what_is_similar(spark):
    import corpus_pipeline

    texts = corpus()
    want = components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted({*want.values()})


def test_sketches_bound_the_difference(spark):
    import numpy as np

    from tidefold.llm import shingle_sets

    rnd = np.random.default_rng(4)
    rows = []
    for n, m, common in [(0, 0, 0), (1, 1, 1), (400, 500, 390), (512, 513, 500), (900, 1100, 850), (3000, 3700, 2990), (5000, 4100, 4000), (20_000, 16_000, 0)]:
        all_ = np.unique(rnd.integers(-(2**63), 2**63, n + m - common, np.int64))
        rnd.shuffle(all_)
        a, b = all_[:n], all_[n - common :]
        rows += [(n + m - 2 * common, f(a).tolist(), f(b).tolist()) for f in (shingle_sets.sketch_of, shingle_sets.fine_sketch_of)]
    for r in spark.createDataFrame(rows, "differ bigint, a array<bigint>, b array<bigint>").selectExpr("differ", f"{shingle_sets._apart('a', 'b')} AS least", f"{shingle_sets._apart('b', 'a')} AS turned", "size(a) + size(b) AS n").collect():
        assert r.least == r.turned <= r.differ and (r.least > 0.7 * r.differ or r.n in (0, 16, 32) or r.differ == 36_000), r


def test_sets_of_texts_far_apart_are_not_shipped(spark, monkeypatch):
    """Neighbours share a passage of rare shingles, so each pair is a candidate; only the few similar ones ship sets."""
    from tidefold.llm import shingle_sets

    rnd = random.Random(6)
    for n in (300, 3000):
        words = [[f"w{rnd.randrange(10**6)}" for _ in range(n)] for _ in range(60)]
        for a, b in zip(words, words[1:], strict=False):
            b[: n // 10] = a[-(n // 10) :]
        texts = {k: " ".join(w) for k, w in enumerate(words)} | {60 + k: " ".join(words[k][:-3]) for k in range(5)}
        shipped = []
        beside = shingle_sets._beside
        monkeypatch.setattr(shingle_sets, "_beside", lambda texts, by_key, how, numbers=None, f=beside, s=shipped: (s.append(numbers or 0), f(texts, by_key, how, numbers))[1])
        df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        got = {r.key: r.component for r in similar_documents(df).collect()}
        monkeypatch.undo()
        assert got == {k: k % 60 for k in texts} and 5 <= sum(shipped) <= 10, (n, shipped)


def test_groups_to_compare_do_not_grow_with_the_corpus(spark, monkeypatch):
    """Each passage is in 60 texts that share nothing else: too many to be tried first, also if the corpus is far larger than _LEARNT."""
    from pyspark.sql import functions as F

    from tidefold.llm import shingle_sets

    rnd = random.Random(7)
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(10)) for _ in range(20)]
    texts = {k: " ".join([*(f"w{rnd.randrange(10**6)}" for _ in range(30)), passages[k % 20]]) for k in range(1200)}
    texts |= {1200 + k: texts[k] + " more" for k in range(5)}
    monkeypatch.setattr(shingle_sets, "_LEARNT", 24)
    largest = []
    written = shingle_sets.written

    def seen(df):
        out = written(df)
        if "hub" in df.columns:
            largest.append(out.groupBy("gram").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(shingle_sets, "written", seen)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.key: r.component for r in similar_documents(docs).collect()}
    assert got == {k: k % 1200 for k in texts} and largest[0] <= 10, largest


def test_learns_the_most_frequent_shingles(spark, monkeypatch):
    from tidefold.llm import shingle_sets

    sets = spark.createDataFrame([([g for g in range(1, 9) if k < g],) for k in range(8)], "grams array<bigint>")
    as_lists = lambda: [x.tolist() for x in shingle_sets._frequent(sets)]
    assert as_lists() == [[3, 4, 5, 6, 7, 8]] * 2
    monkeypatch.setattr(shingle_sets, "_KNOWN", 2)
    assert as_lists() == [[7, 8]] * 2
    assert [len(x) for x in shingle_sets._frequent(sets.limit(0))] == [0, 0]


def test_few_links_take_no_rounds(spark, monkeypatch):
    from tidefold.llm import components as c

    rnd = random.Random(8)
    for kind, make in (("bigint", int), ("string", lambda x: f"k{x:03}")):
        edges = spark.createDataFrame([(make(rnd.randrange(200)), make(rnd.randrange(200))) for _ in range(120)], f"u {kind}, v {kind}")
        want = {r.node: r.component for r in c.connected_components(edges).collect()}
        with monkeypatch.context() as m:
            m.setattr(c, "_large_star", None)
            got = [tuple(r) for r in c.connected_components(edges, 120).collect()]
            assert len(got) == len(want) and dict(got) == want and len({*want.values()}) > 3
            assert c.connected_components(edges.limit(0), 120).collect() == []
