"""Packing: ids equal the tokenizer's, every id in exactly one piece, no padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidefold.llm.packing import Encoder, Packer, pack, step_groups

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\n\n", "a", "é", "\t", "\x1c", "\x85", "\xa0", "'s", "12", "!!", "The", "ß", "<|endoftext|>", "\r\n", "日本", " \n", "　", ".", "%%%", "a.", "é,"]


def test_ids_equal_the_tokenizer():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["", " ", "\n"]
    e = Encoder(PATH)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.fast is not None and [e.encode(t) for t in texts] == want


def test_ids_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = ["end<|endoftext|>start", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext", *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(1000))]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert len(want[0]) == 4 * 3
    e = Encoder(PATH)
    assert [e.encode(t) for t in texts] == want


def test_ids_of_all_letters_and_of_long_runs():
    e = Encoder(PATH)
    texts = ["".join(f"a{c}b {c}1{c} {c}!{c}'" for c in map(chr, range(k, k + 256))) for k in range(0, 0x30000, 256) if not 0xD800 <= k < 0xE000]
    texts += [" " * 1_200_000 + "x", "a" * 200_000, "é" * 100_000, "\n" * 1_200_000]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [e.encode(t) for t in texts] == want


def test_other_kinds_of_files_are_left_to_the_library(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    (tmp_path / "swapped.json").write_text(json.dumps(spec))
    e = Encoder(str(tmp_path / "swapped.json"))
    assert e.fast is None and e.encode("The end") == np.array(e.tokenizer.encode("The end").ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_full_and_cover_once(seed):
    rnd = random.Random(seed)
    p, windows = Packer(), []
    sizes = {i: rnd.choice([rnd.randint(1, 200), rnd.randint(1, 3000)]) for i in range(rnd.randint(0, 60))}
    for i, n in sizes.items():
        windows += p.add(i, n)
        if rnd.random() < 0.1:
            windows += p.pack()
    windows += p.rest()
    seen = {i: np.zeros(n, int) for i, n in sizes.items()}
    for w in windows:
        total = sum(x[2] for x in w)
        assert total & (total - 1) == 0 and total <= 1024
        for doc, start, n in w:
            seen[doc][start : start + n] += 1
    assert all((s == 1).all() for s in seen.values())
    groups = dict(step_groups(windows))
    assert sorted(groups) == list(range(len(windows)))
    for g in set(groups.values()):
        own = [windows[k] for k, v in groups.items() if v == g]
        assert len({sum(x[2] for x in w) for w in own}) == 1 and len(own) <= 8


def test_tiers_are_checked():
    with pytest.raises(ValueError):
        Packer((100, 50))


def test_round_trip(spark):
    rows = [(1, "one two three", "x"), (2, None, "y"), (2, "", "z"), (3, "word " * 5000, None), (None, "no key", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset string").repartition(2)
    pieces = pack(docs, PATH).collect()
    t = Encoder(PATH)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert len(p["ids"]) == 4 * p.length
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == own[0].tier
    for key, text in ((1, "one two three"), (3, "word " * 5000), (None, "no key")):
        own = sorted((p for p in pieces if p.key == key), key=lambda p: p.start)
        assert b"".join(p["ids"] for p in own) == t.encode(text) + bytes(4)
    assert [(p.start, p.length, zlib.crc32(p["ids"])) for p in pieces if p.key == 2] == [(0, 1, zlib.crc32(bytes(4)))] * 2
    assert pack(docs.limit(0), PATH).collect() == []
