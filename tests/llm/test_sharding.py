"""Exact shard sizes, gapless slots, and a uniform law."""

from collections import Counter

import numpy as np

from tidefold.llm import sharding
from tidefold.llm.sharding import hypergeometric_shuffle, matrix_row


def test_matrix_rows_have_both_sums():
    counts = np.array([5, 0, 9, 3, 7, 1])
    before = np.concatenate(([0], np.cumsum(counts)))
    colours = np.array([10, 10, 5])
    matrix = np.stack([matrix_row(p, before, colours, 1) for p in range(6)])
    assert (matrix.sum(1) == counts).all() and (matrix.sum(0) == colours).all() and (matrix >= 0).all()


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 3_000_000_000, 9_000_000_000, 1000) for _ in range(2000)]
    assert abs(np.mean(draws) - 250) < 2 and abs(np.var(draws) - 187.5) < 25


def test_shuffle(spark):
    rows = [(k % 90, f"t{k}", "a", "b") for k in range(103)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, _hg string").repartition(5)
    got = hypergeometric_shuffle(docs, 4, seed=1, block_rows=10)
    assert set(got.columns) == {"doc_id", "text", "_hg", "shard", "slot"}
    got = got.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(r[:2] for r in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == [25, 26, 26, 26]
    assert hypergeometric_shuffle(docs.limit(0), 4).collect() == []
    odd = spark.createDataFrame([(None, "x", 1, 2, 3, "r"), (None, None, 1, 2, 3, "r")], "doc_id bigint, text string, part int, block int, `order` int, `row` string")
    for size in (1, 100):
        found = hypergeometric_shuffle(odd, 1, block_rows=size)
        assert found.columns == ["doc_id", "text", "part", "block", "order", "row", "shard", "slot"] and sorted(r.slot for r in found.collect()) == [0, 1]
    few = hypergeometric_shuffle(docs.limit(2), 4).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_a_draw_costs_the_same_for_any_number_of_rows():
    """10 ** 11 rows in 100,000 partitions: a task's row of the matrix in well under 5 seconds."""
    import time

    before = np.arange(100_001, dtype=np.int64) * 1_000_000
    colours = np.array(sharding.shard_sizes(10**11, 40), np.int64)
    began = time.perf_counter()
    row = matrix_row(77_777, before, colours, 3)
    assert row.sum() == 1_000_000 and time.perf_counter() - began < 5
    assert abs(row - 25_000).max() < 1200


def test_shuffle_is_uniform(spark, tmp_path):
    spark.range(8).repartition(3).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    where = Counter()
    for seed in range(60):
        for r in hypergeometric_shuffle(source, 2, seed=seed, block_rows=2).collect():
            where[(r.id, r.shard)] += 1
    assert all(12 <= where[(i, s)] <= 48 for i in range(8) for s in range(2))
