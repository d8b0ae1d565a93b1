"""Benchmark decontamination: one FM-index per training shard, searched backwards for every benchmark window."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import LOWER, slices, text_of, utf8_values
from tidefold.llm.fm_index import FMIndex

WINDOW = 10
#: Most bytes of benchmark text that one pass over the documents carries to the tasks; a larger benchmark is dealt over several passes.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a shard. A document is never cut: one beyond this size is a shard of its own.
SHARD_BYTES = 16 << 20
_OUT = "key {0}, text string, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: every other byte becomes a space.
_WORDS = bytes(32 if LOWER[c] <= 0x2F or 0x3A <= LOWER[c] <= 0x60 or 0x7B <= LOWER[c] <= 0x7F else LOWER[c] for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Patterns:
    """The distinct windows of a block of benchmark items, as symbols of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), {})[item] = None
        self.items = [list(x) for x in found.values()]
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.rows = np.zeros((len(found), window), np.int64)
        for row, w in zip(self.rows, found, strict=True):
            row[window - len(w) :] = w
        self.shortest = int(self.lengths.min()) if len(found) else 0


def _runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the words to index: those in runs of at least `shortest` words of the vocabulary.

    No window holds a word from outside the vocabulary, and none fits into a shorter run, so an index of these
    runs, with a mark between them, has every occurrence that the whole sequence has.
    """
    known = np.concatenate(([0], (ids > 1).astype(np.int8), [0]))
    edges = np.diff(known)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long] + 1  # with the mark that follows
    if not len(starts):
        return np.empty(0, np.int64)
    lengths = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))


def search_shard(texts: list[bytes], patterns: Patterns) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
    """For each text: its words, the merged spans of words to remove (starts, ends), and the items found in it."""
    get = patterns.vocabulary.get
    words = [words_of(t) for t in texts]
    # after each document, and for each word from outside the vocabulary: symbol 1, in no pattern
    counts = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    flat = np.fromiter((x for one in words for x in (*map(get, one, repeat(1)), 1)), np.int64, int(first[-1]))
    del words
    place = _runs(flat, patterns.shortest) if patterns.shortest else np.empty(0, np.int64)
    starts: list[list[int]] = [[] for _ in texts]
    ends: list[list[int]] = [[] for _ in texts]
    items: list[dict[str, None]] = [{} for _ in texts]
    if len(place):
        index = FMIndex(np.where(place < len(flat), flat[np.minimum(place, len(flat) - 1)], 1), len(patterns.vocabulary) + 2)
        a, b = index.ranges(patterns.rows, patterns.lengths)
        n = b - a
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) + np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        at = place[index.locate(rows)]
        by = np.argsort(at, kind="stable")
        at, which = at[by], which[by]
        doc = np.searchsorted(first, at, side="right") - 1
        for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist():
            items[d].update(dict.fromkeys(patterns.items[w]))
        if len(at):
            reach = np.maximum.accumulate(at + patterns.lengths[which])
            new = np.concatenate(([True], (at[1:] > reach[:-1]) | (doc[1:] != doc[:-1])))
            heads = np.flatnonzero(new)
            for d, s, e in zip(doc[heads].tolist(), at[heads].tolist(), reach[np.append(heads[1:], len(at)) - 1].tolist(), strict=True):
                starts[d].append(s - int(first[d]))
                ends[d].append(e - int(first[d]))
    for k in range(len(texts)):
        yield int(counts[k]), starts[k], ends[k], list(items[k])


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple[str, bytes]]]:
    """The benchmark, in blocks of at most BLOCK_BYTES (one longer item stands alone)."""
    blocks: list[list[tuple[str, bytes]]] = [[]]
    held = 0
    rows = benchmark.select(benchmark[item].cast("string").alias("item"), text_of(benchmark, text).alias("text")).where("item is not null")
    for row in rows.toLocalIterator():
        data = row["text"].encode()
        if held and held + len(data) > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append((row["item"], data))
        held += len(data)
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, spans, items): for every document the spans of words inside benchmark windows, and the items found.

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Spans
    are sorted, disjoint structs (start, end) of word positions. Texts that are null have no words; an item whose id
    is null is left out; repeated items and keys are kept as they come; empty tables give empty spans or no rows.
    The benchmark is read in blocks of at most BLOCK_BYTES, one pass over the documents for each; documents are
    never shuffled for a benchmark of one block. Shards hold SHARD_BYTES of text, so memory doesn't grow with the table.
    """
    kind = docs.schema[key].dataType.simpleString()
    none = F.array().cast("array<bigint>")
    now = docs.select(docs[key].alias("key"), text_of(docs, text).alias("text"), F.lit(0).cast("bigint").alias("n_words"), none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    for block in _blocks(benchmark, item, text):
        patterns = Patterns(block, window)

        def run(batches: Iterator[pa.RecordBatch], patterns: Patterns = patterns) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, SHARD_BYTES, "text"):
                found = search_shard(utf8_values(b.column("text")), patterns)
                rows = [_joined(f, *before) for f, *before in zip(found, *(b.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)]
                n, starts, ends, items = map(list, zip(*rows, strict=True))
                yield pa.record_batch([b.column("key"), b.column("text"), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["key", "text", "n_words", "starts", "ends", "items"])

        now = now.mapInArrow(run, _OUT.format(kind))
    return now.select("key", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), F.array_sort("items").alias("items"))


def _joined(found: tuple, starts: list[int], ends: list[int], items: list[str]) -> tuple[int, list[int], list[int], list[str]]:
    """What one pass found put together with what earlier passes did."""
    n, new_starts, new_ends, new_items = found
    if not starts:
        return n, new_starts, new_ends, new_items
    spans: list[list[int]] = []
    for s, e in sorted([*zip(starts, ends, strict=True), *zip(new_starts, new_ends, strict=True)]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return n, [s for s, _ in spans], [e for _, e in spans], list(dict.fromkeys([*items, *new_items]))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(LOWER))]
    out, done = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, text[done:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """`docs` with all its columns, benchmark windows cut out of the text (see `contamination`); other texts stay as they are.

    What a cut brings together is searched again, until no window is left. Null texts stay null.
    """
    names, now = docs.columns, docs
    place = names.index(text)
    for block in _blocks(benchmark, item, "text"):
        patterns = Patterns(block, window)

        def run(batches: Iterator[pa.RecordBatch], patterns: Patterns = patterns) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, SHARD_BYTES, text):
                texts = [t or b"" for t in utf8_values(b.column(place))]
                todo = list(range(len(texts)))
                changed = set()
                while todo:
                    hit = [(k, s, e) for k, (_, s, e, _) in zip(todo, search_shard([texts[k] for k in todo], patterns), strict=True) if s]
                    for k, s, e in hit:
                        texts[k] = _cut(texts[k], s, e)
                    todo = [k for k, _, _ in hit]
                    changed.update(todo)
                if changed:
                    whole = b.column(place).to_pylist()
                    column = pa.array([texts[k].decode() if k in changed else whole[k] for k in range(len(texts))], b.schema.field(place).type)
                    b = pa.RecordBatch.from_arrays([*b.columns[:place], column, *b.columns[place + 1 :]], names)
                yield b

        now = now.mapInArrow(run, docs.schema)
    return now
