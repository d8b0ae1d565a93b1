"""SimHash against brute force: fingerprints, covering, links and components."""

import itertools
import random

import numpy as np
import xxhash

from tidefold.llm.components import connected_components
from tidefold.llm.simhash import covering_masks, links, near_duplicates


def plain(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(edges, nodes):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_every_close_pair_shares_a_table():
    masks = covering_masks(2)
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m & (1 << a | 1 << b) for m in masks)


def test_links_connect_what_is_close(spark):
    rnd = random.Random(2)
    values = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(10):
            values.add(x)
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), k) for k, v in enumerate(values)], "fp bigint, id bigint")
    got = [(r.u, r.v) for r in links(nodes).collect()]
    assert all((values[u] ^ values[v]).bit_count() <= 2 for u, v in got)
    close = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 2]
    assert components(got, range(len(values))) == components(close, range(len(values)))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == components(edges, {x for e in edges for x in e})
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_near_duplicates(spark):
    rnd = random.Random(5)
    words = [rnd.choice("abcdefgh") + str(k) for k in range(200)]
    base = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(4)]
    texts = [None, "", "  ", "Éa b", "one"] + base + [b + " tail" for b in base] + [b.upper() for b in base] + ["x " * 20000]
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(3, "Éa b", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component string").repartition(3)
    got = near_duplicates(docs).collect()
    prints = {(k, t): plain(t) for k, t, _ in rows}
    assert sorted((r.key, int(np.int64(r.fp).view(np.uint64))) for r in got) == sorted((k, plain(t)) for k, t, _ in rows)
    ids = {k: prints[(k, t)] for k, t, _ in rows}
    close = [(a, b) for a, b in itertools.combinations(ids, 2) if (ids[a] ^ ids[b]).bit_count() <= 2]
    want = components(close, ids)
    assert {r.key: r.component for r in got} == want
    assert near_duplicates(docs.limit(0)).collect() == []
