"""Repeated substrings against brute force, and the chunk-wise reducers against one chunk."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidefold.llm import pfp_dedup
from tidefold.llm.pfp_dedup import repeated_substrings, suffix_runs


def brute(rows):
    first, out = {}, []
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if k is not None else 0):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    for k, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 49 if k is not None else 0):
            if first[b[i : i + 50]] < k:
                covered[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((k, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéf ") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200))) for _ in range(12)]
    noise = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
    rows = []
    for k in range(n):
        r = rnd.random()
        if r < 0.2:
            t = rnd.choice(base)
        elif r < 0.5:
            t = list(rnd.choice(base) + rnd.choice(base))
            for _ in range(rnd.randint(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice("xyz")
            t = "".join(t)
        elif r < 0.7:
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            t = noise("pqrst") + b[i : i + rnd.choice([49, 50, 51, 60, 200])] + noise("uvw")
        elif r < 0.8:
            t = rnd.choice(["", "a" * 49, "a" * 50, "a" * 400, "ab" * 100, None])
        else:
            t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300)))
        rows.append((rnd.choice([k, k, k, k, rnd.randrange(n), None]), t))
    return rows


def run(df):
    return sorted(((r.key, len(r.text.encode()), sum(e - s for s, e in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in repeated_substrings(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id bigint, text string, k string, th string").repartition(5)
    assert run(df) == brute(rows)


def test_rows_of_one_key_each_lose_their_own_bytes(spark):
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(1, shared[100:700]), (5, "x" * 30 + shared[:800]), (5, "y" * 70 + shared[50:]), (7, shared)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_suffix_runs():
    rnd = random.Random(0)
    data = bytes(rnd.choice(b"ab") for _ in range(400)) + b"ab" * 60
    order, run_of = suffix_runs(data, np.arange(len(data) - 11), 11)
    own = [data[i : i + 11] for i in range(len(data) - 11)]
    assert [own[i] for i in order] == sorted(s for s in own if own.count(s) > 1)
    assert len({(r, own[i]) for i, r in zip(order, run_of, strict=True)}) == len({own[i] for i in order}) == len(set(run_of))


def test_chunks_make_no_difference(monkeypatch):
    """The whole chain in one process: parse, share, contexts, repeats, with chunks of one blob and of all."""
    import pyarrow as pa

    rows = [(k, (t or "").encode()) for k, t in corpus(11) if k is not None]
    batch = lambda extra: pa.record_batch([pa.array([k for k, _ in rows]), pa.array(range(len(rows)), pa.int32()), pa.array([t.decode() for _, t in rows]), *extra.values()], ["key", "th", "text", *extra])

    def chain(chunk, size, most=1 << 30):
        monkeypatch.setattr(pfp_dedup, "_CHUNK", chunk)
        monkeypatch.setattr(pfp_dedup, "_SLICE", size)
        monkeypatch.setattr(pfp_dedup, "_HOT", most)
        found = [x for b in pfp_dedup._shared(pfp_dedup._parsed([batch({})], 1)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        busy = [x for x in found if pfp_dedup._BUSY <= x[2] < pfp_dedup._SETTLED]
        assert bool(busy) == (most < 1 << 30)
        found = [x for x in found if x not in busy]
        hot = np.array(sorted(x[2] ^ pfp_dedup._BUSY for x in busy), np.int64)
        anchors = [sorted({(v, tag) for k, th, v, tag in found if v >= 0 and th == i}) for i in range(len(rows))]
        spans = {x[:3] for x in found if x[2] < 0}
        kind = pa.list_(pa.struct([("value", pa.int64()), ("tag", pa.int64())]))
        asked = pa.array([[{"value": v, "tag": t} for v, t in own] for own in anchors], kind)
        around = pfp_dedup._contexts([batch({"anchors": asked})], 1, hot)
        spans |= {x[:3] for b in pfp_dedup._repeats(around) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        covered = {i: set() for i in range(len(rows))}
        for _, th, v in spans:
            start, n = (-1 - v) >> 31, (-1 - v) & 0x7FFFFFFF
            covered[th] |= {*range(start, start + n)}
        return covered

    whole = chain(1 << 30, 1 << 30)
    assert any(whole.values())
    for chunk, size, most in ((1, 700, 1 << 30), (1 << 30, 90, 1 << 30), (1, 200, 2), (5000, 1 << 20, 3)):
        assert chain(chunk, size, most) == whole


def test_one_text_in_pieces(monkeypatch):
    """Pieces of a long text hold each of its windows once."""
    monkeypatch.setattr(pfp_dedup, "_SLICE", 64)
    text = bytes(random.Random(0).choice(b"abc") for _ in range(1000))
    for n in (0, 49, 50, 64, 65, 112, 113, 114, 1000):
        out, doc, start = pfp_dedup.pieces([text[:n]])
        assert [a + i for p, a in zip(out, start.tolist(), strict=True) for i in range(max(0, len(p) - 49))] == list(range(max(0, n - 49)))
        assert not doc.any() and all(text[a : a + len(p)] == p for p, a in zip(out, start.tolist(), strict=True))


def test_colliding_context_tags_are_not_needed_for_other_windows(monkeypatch):
    """Windows that no tag settles are compared by their bytes: with every tag different, the result is the same."""
    import pyarrow as pa

    rows = [(k, (t or "").encode()) for k, t in corpus(5) if k is not None]
    batch = lambda extra: pa.record_batch([pa.array([k for k, _ in rows]), pa.array(range(len(rows)), pa.int32()), pa.array([t.decode() for _, t in rows]), *extra.values()], ["key", "th", "text", *extra])

    def spans():
        found = [x for b in pfp_dedup._shared(pfp_dedup._parsed([batch({})], 1)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        kind = pa.list_(pa.struct([("value", pa.int64()), ("tag", pa.int64())]))
        asked = pa.array([[{"value": v, "tag": t} for v, t in sorted({(x[2], x[3]) for x in found if x[2] >= 0 and x[1] == i})] for i in range(len(rows))], kind)
        out = {x[1:3] for x in found if x[2] < 0}
        out |= {x[1:3] for b in pfp_dedup._repeats(pfp_dedup._contexts([batch({"anchors": asked})], 1, np.empty(0, np.int64))) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        return {(th, p) for th, v in out for p in range((-1 - v) >> 31, ((-1 - v) >> 31) + ((-1 - v) & 0x7FFFFFFF))}

    want, counter = spans(), iter(range(1 << 40))
    monkeypatch.setattr(pfp_dedup.Parse, "context_tags", lambda self, texts, which: np.array([next(counter) for _ in self.at[which]], np.uint64))
    assert spans() == want


def test_more_rows_than_two_bytes_can_number(spark):
    """72,000 equal texts in one batch: all but the first go."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        df = spark.range(72000, numPartitions=1).selectExpr("id AS doc_id", "repeat('abcde', 11) AS text")
        got = repeated_substrings(df).selectExpr("count_if(octet_length(kept) = 0) AS n", "max_by(key, octet_length(kept)) AS first").first()
        assert (got.n, got.first) == (71999, 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _asked(texts):
    """Records of anchors whose contexts would be shipped."""
    b = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts), pa.int32()), pa.array([t.decode() for t in texts])], ["key", "th", "text"])
    return sum(sum(0 <= v < pfp_dedup._BUSY for v in x.column("value").to_pylist()) for x in pfp_dedup._shared(pfp_dedup._parsed([b], 1)))


def test_anchors_without_a_common_side_are_not_shipped():
    """Texts of few words share nearly all runs of 16 bytes, but few of the 32 that equal windows must share."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(20)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)).encode() for _ in range(100)]
    anchors = sum(len(pfp_dedup.parse([t]).at) for t in texts)
    assert 0 < _asked(texts) < anchors // 2


def test_common_anchors_come_out_whole(monkeypatch):
    """An anchor with more open records than sides can tell apart leaves one record; all the others come out."""
    n = 200
    records = [np.full(n, 7), np.arange(n), np.arange(1, n + 1) * 0x10001, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    state, out = pfp_dedup._shared_anchors(None, records)
    assert len(state[0]) == n and out.num_rows == 0
    monkeypatch.setattr(pfp_dedup, "_COMMON", 50)
    state, out = pfp_dedup._shared_anchors(None, records)
    assert len(state[0]) == 1 and state[5][0] == n and out.num_rows == n
    state, out = pfp_dedup._shared_anchors(state, [c[:3] + n * (i in (1, 3)) for i, c in enumerate(records)])
    assert len(state[0]) == 1 and state[5][0] == n + 3 and out.num_rows == 3


def test_a_context_that_one_document_has_twice_goes_twice(monkeypatch):
    """The smaller document comes in a later chunk: both places of the larger one go."""
    monkeypatch.setattr(pfp_dedup, "_CHUNK", 1)
    context = np.frombuffer(bytes(range(65, 149)), "S84")
    batches = []
    for key, at in ((9, [100, 300]), (1, [500])):
        n = len(at)
        columns = [np.repeat(context, n), np.array(at, "<u4"), np.zeros(n, "u1"), np.full(n, 34, "u1")]
        batches.append(pfp_dedup._emit(list(pfp_dedup._blob_rows(pfp_dedup._CONTEXTS, np.zeros(n, np.int64), columns, np.zeros(n, np.int64), np.array([[key, 0]], np.int64)))))
    spans = [(k, -1 - v >> 31) for b in pfp_dedup._repeats(iter(batches)) for k, _, v, _ in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(spans) == [(9, 66), (9, 266)]


def test_shuffle_files_of_what_is_written_are_deleted(spark, monkeypatch):
    from tidefold.sources import checkpoints

    spark.conf.unset(checkpoints._CLEANUP)
    default, seen = spark.conf.get(checkpoints._CLEANUP), []
    writer = type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path: (seen.append(spark.conf.get(checkpoints._CLEANUP)), parquet(self, path))[1])
    assert checkpoints.written(spark.range(10).repartition(3, "id")).count() == 10
    assert seen == ["true"] and spark.conf.get(checkpoints._CLEANUP) == default


def test_buckets_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """A task's records don't grow with the input, however few partitions the session has; several slices are dealt together."""
    rows = corpus(5)
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(pfp_dedup, "_BUCKET", size // 10)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert repeated_substrings(df).rdd.getNumPartitions() == -(-size // (size // 10)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert run(df) == brute(rows)


@pytest.mark.parametrize("dealt", [0, 3000, 1 << 30])
def test_slices_dealt_together_name_their_own_documents(monkeypatch, dealt):
    monkeypatch.setattr(pfp_dedup, "_DEALT", dealt)
    texts = [f"{'common passage of text that all of these documents have ' * 2}{k}" for k in range(9)]
    batches = [pa.record_batch([pa.array(range(k, k + 3)), pa.array([5, 6, 7], pa.int32()), pa.array(texts[k : k + 3])], ["key", "th", "text"]) for k in (0, 3, 6)]
    got = list(pfp_dedup._parsed(iter(batches), 1))
    named = set()
    for chunk in pfp_dedup._gathered(iter(got)):
        for columns in chunk.values():
            named |= set(zip(columns[-2].tolist(), columns[-1].tolist(), strict=True))
    assert named <= {(k, 5 + k % 3) for k in range(9)} and {k for k, _ in named} == set(range(9))
    assert dealt or len(got) > 3
