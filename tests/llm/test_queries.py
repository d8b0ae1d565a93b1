"""The contracted columns of the query wrappers, against plain Python on a small table with every awkward row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tidefold.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    words = [a + b for a in "bdfgklm" for b in ("an", "er", "is", "ou", "él")]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    items = [("i1", " ".join(rnd.choice(words) for _ in range(14))), ("i2", "Only Three words"), ("i10", passage[:200]), ("i3", None), ("i4", "...")]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE two"), (4, "  "), (5, "only three, WORDS and more")]
    for k in range(6, 60):
        t = " ".join(rnd.choice(words).title() if rnd.random() < 0.2 else rnd.choice(words) for _ in range(rnd.choice([3, 20, 120])))
        if k % 5 == 0:
            t = f"{t} {passage} {t[:60]}\n{rnd.choice(items[:2])[1]} end"
        if k % 7 == 0:
            t = rows[k - 3][1] or "copy"
        rows.append((k, t))
    rows.append((60, "long " * 3000))
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 1)) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), items


def test_op1(spark, tables):
    from tokenizers import Tokenizer

    folder, texts, _ = tables
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    seen = {k: 0 for k in texts}
    rows = sorted(queries.op1_hierarchical_packing(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    ends = Counter()
    for r in rows:
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert seen == {k: len(v) for k, v in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and all(n & (n - 1) == 0 for n in ends.values())


def test_op3(spark, tables):
    folder, texts, _ = tables
    rows = queries.op3_counterfactual_toxicity(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op4(spark, tables):
    folder, texts, items = tables
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = [(i, tuple(w[k : k + 10])) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - 9))]
    for r in queries.op4_benchmark_decontamination(spark, folder).collect():
        w = split(texts[r.doc_id])
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= {*range(k, k + len(x))}
                    found.add(item)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_op6(spark, tables):
    folder, texts, _ = tables
    rows = queries.op6_hypergeometric_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert {*slots} <= {*range(40)} and all(sorted(v) == [*range(len(v))] for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_op7(spark, tables):
    folder, texts, _ = tables
    for r in queries.op7_segment_line_dedup(spark, folder).collect():
        assert r.n_lines == len((texts[r.doc_id] or "").split("\n"))
        if not r.n_equal + r.n_near:
            assert r.kept_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op8(spark, tables):
    folder, texts, _ = tables
    rows = queries.op8_cotraining_quality(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(0 <= x <= 1 for r in rows for x in (r.score, r.p_content, r.p_metadata)) and all(r.kept == (r.score >= 0.5) for r in rows)


def test_op9(spark, tables):
    folder, texts, _ = tables
    prints = {}
    for k, t in texts.items():
        w = WORD.findall(lowered(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] < group[b]:
                    group[b] = group[a]
                    changed = True
    rows = queries.op9_simhash_near_duplicates(spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{f:016x}", group[k]) for k, f in prints.items()}


def test_op10(spark, tables):
    folder, texts, _ = tables
    first = {}
    for k in sorted(texts):
        data = (texts[k] or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], k)
    for r in queries.op10_prefix_free_parsing_dedup(spark, folder).collect():
        data = (texts[r.doc_id] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_pipeline_stages_take_awkward_rows(spark, tables):
    """Nulls, repeats, clashing names and empty tables through every stage; the last one's pieces cover what the others left."""
    import corpus_pipeline

    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS key", "2 AS component", "3 AS h")
    more = spark.createDataFrame([(None, "no id at all", None, None, None, 1, 2, 3), (7, None, None, "src0", 0, 1, 2, 3)], docs.schema)
    docs = docs.unionAll(more).unionAll(more)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0, name
