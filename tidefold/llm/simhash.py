"""SimHash near-duplicates by covering locality-sensitive hashing (no pair within the radius is missed)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import LOWER, slices, text_of, trim, utf8_values
from tidefold.llm.components import connected_components
from tidefold.sources.checkpoints import checkpointed

SEED = 42
#: Bytes of text whose shingles are hashed at a time; a longer text is taken in pieces of this size.
_BATCH = 256 << 10
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every `size`-word shingle, repeats included; of the whole sequence where it has fewer words.

    In pieces: a text of any length is cut at separators, and the last size - 1 words go over to the next piece.
    """
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    at, whole = 0, True
    while at < len(text):
        end = at + _BATCH
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        words = carried + text[at:end].translate(LOWER).split()
        at = end
        if len(words) >= size:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths)
            rows = zip((ends - lengths)[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
            yield np.fromiter((digest(line[a:b], SEED) for a, b in rows), np.uint64, len(words) - size + 1)
            whole = False
        carried = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if whole and carried:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes, a row each."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints_of(texts: list[bytes], size: int = 3) -> np.ndarray:
    """A 64-bit fingerprint for each text: a bit is 1 if set in over half its shingle hashes; 0 without words."""
    counts = np.zeros(len(texts), np.int64)
    ones = np.zeros((len(texts), 64), np.int64)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def add() -> None:
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(ones, owner, np.add.reduceat(_ones(np.concatenate(held)), starts, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()

    for k, text in enumerate(texts):
        for hashes in shingle_hashes(text, size):
            counts[k] += len(hashes)
            held.append(hashes)
            owner.append(k)
            if len(hashes) > 8192:
                add()
    add()
    return np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of sets of shingle hashes: a bit is 1 if set in over half of them; 0 for an empty set."""
    out = np.zeros(len(sets), np.uint64)
    for k, own in enumerate(sets):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(own), 8192):
            ones += _ones(own[a : a + 8192].view(np.uint64)).sum(0, dtype=np.int64)
        out[k] = np.packbits((2 * ones > len(own)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp): the SimHash of every whole text as a signed 64-bit number. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _BATCH, "text"):
            yield pa.record_batch([b.column("key"), pa.array(fingerprints_of(utf8_values(b.column("text")), size).view(np.int64))], ["key", "fp"])
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks such that any two values at most `radius` bits apart agree under at least one of them.

    Bit i gets a nonzero vector m(i) of radius + 1 bits; for each nonzero v, the mask keeps the bits whose m(i) has
    an odd inner product with v. The vectors of `radius` differing bits never span the space, so some v is
    orthogonal to all of them and its mask drops them all.
    """
    n = (1 << radius + 1) - 1
    vectors = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints of `nodes` (distinct fp, id) at 2 or fewer differing bits.

    Covering tables find the buckets that hold several fingerprints. Within a bucket, fingerprints differ only in
    bits the mask drops; each offers itself and its one-bit changes there. Two share an offer exactly if they are
    within 2 bits, so linking every offer to the smallest id with it keeps all connections and makes no pair
    twice over: rows stay linear in the bucket's size, however large the group is.
    """
    masks = covering_masks(2)
    entry = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for j, m in enumerate(masks)])
    tables = nodes.select("fp", "id", F.explode(entry).alias("e")).select("fp", "id", "e.j", "e.kept")
    shared = tables.groupBy("j", "kept").agg(F.count("*").alias("n")).where("n > 1").select("j", "kept")
    offers = F.element_at(F.array(*[F.array(*[F.lit(0).cast("bigint")], *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("j") + 1)
    met = tables.join(shared, ["j", "kept"], "left_semi").select("id", "fp", F.explode(offers).alias("x")).select("id", F.col("fp").bitwiseXOR(F.col("x")).alias("offer"))
    met = met.distinct()
    hubs = met.groupBy("offer").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").select("offer", "v")
    return met.join(hubs, "offer").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """(key, component) over pairs of texts of a given Jaccard similarity: see `shingle_sets.similar_documents`."""
    from tidefold.llm import shingle_sets  # which builds on this module

    return shingle_sets.similar_documents(docs, **options)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp, component): SimHash of every text, and the smallest key reachable over links of at most 2 bits.

    Equal fingerprints are one node, so a group of copies costs one row per table; links between different
    fingerprints all count (see `links`). Null and empty texts have fingerprint 0, which links like any other.
    Repeated keys share the smallest component of their rows' fingerprints' groups; an empty table gives no rows.
    Needs integer or otherwise orderable keys; columns besides key and text are not read.
    """
    prints = checkpointed(fingerprints(docs, key, text, size))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("key").alias("id")))
    component = connected_components(links(nodes))
    named = nodes.join(component, nodes["id"] == component["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))
    return prints.join(named, "fp").select("key", "fp", "component")
