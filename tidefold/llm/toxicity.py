"""A toxicity classifier regularised by counterfactuals: swapping identity terms must not move its score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import slices, text_of, trim
from tidefold.llm.linear import Sparse, fit, platt, sigmoid, telling

#: Identity terms by group; a term is swapped for the others of its group (fixed values).
IDENTITY: list[list[str]] = [
    ["women", "men", "woman", "man", "girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "catholic", "protestant"],
    ["black", "white", "asian", "latino", "african", "european", "american"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"],
    ["immigrants", "refugees", "foreigners", "citizens", "locals"],
    ["old", "young", "elderly", "teenage"],
    ["disabled", "deaf", "blind", "autistic"],
    ["frauen", "männer", "frau", "mann", "juden", "christen", "ausländer"],
    ["femmes", "hommes", "femme", "homme", "juifs", "chrétiens", "musulmans", "immigrés"],
    ["mujeres", "hombres", "mujer", "hombre", "judíos", "cristianos", "musulmanes", "inmigrantes"],
]
BITS = 18
_SIGNS = ".,;:!?\"'()[]{}#*$%&|<>"
_PREFIXES = (4, 5, 6, 7)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _word_features(word: str) -> tuple[int, ...]:
    plain = word.strip(_SIGNS).lower()
    if not plain:
        return ()
    mask = (1 << BITS) - 1
    return (xxhash.xxh32_intdigest("w" + plain) & mask, *(xxhash.xxh32_intdigest("p" + plain[:n]) & mask for n in _PREFIXES if len(plain) > n))


class _Features:
    """Hashed words and word beginnings of a text, each once; the cache of words is bounded."""

    def __init__(self, most: int = 500_000) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}
        self.most = most

    def __call__(self, text: str) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache.clear()
        found: set[int] = set()
        for w in set(text.split()):
            f = self.cache.get(w)
            if f is None:
                f = self.cache[w] = _word_features(w)
            found.update(f)
        return np.fromiter(found, np.int32, len(found))


def _difference(one: np.ndarray, two: np.ndarray) -> bytes:
    """Features that only one of two texts has, counted from 1, those of the second negative."""
    return np.concatenate((np.setdiff1d(one, two) + 1, -np.setdiff1d(two, one) - 1)).astype(np.int32).tobytes()


_GROUP = {term: group for group in IDENTITY for term in group}


def _plain(word: str) -> str:
    return word.strip(_SIGNS).lower()


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Every sentence with an identity term, for each of its terms and each other term of the group: the sentence, and the same about the other."""
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        for at, w in enumerate(words):
            for other in _GROUP.get(_plain(w), ()):
                if other != _plain(w):
                    yield sentence, " ".join([*words[:at], other, *words[at + 1 :]])


def made_up(text: str, salt: int, most: int) -> Iterator[tuple[str, str]]:
    """Up to `most` sentences without an identity term, one of each of a pair put in front."""
    plain = (s for s in _SENTENCE.split(text) if s.strip() and not any(_plain(w) in _GROUP for w in s.split()))
    for k, sentence in zip(range(most), plain, strict=False):
        group = IDENTITY[(salt + k) % len(IDENTITY)]
        one = (salt * 7 + k) % len(group)
        yield f"{group[one]} {sentence}", f"{group[(one + 1 + (salt * 3 + k) % (len(group) - 1)) % len(group)]} {sentence}"


@dataclass
class Model:
    """weights[renumbering[feature]]; 2 ** BITS entries, whatever the corpus."""

    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 8000, pull: float = 1.0, z: float = 2.5, made: int = 4) -> Model:
    """Fit on at most `most` labelled rows (those with the smallest hash of their key), up to half of them toxic.

    Features come from the executors as numbers, so the driver gets no text. A feature counts if its log-odds of
    the toxic label exceed zero by `z` standard errors, or if a swap of identity terms changes it in some sentence:
    so the terms' own weights, of either sign, are fitted, and the penalty holds them together. The logistic loss is
    joined by `pull` times the mean squared change of the score over counterfactual pairs: of every sentence with
    an identity term, for each term each other of its group, and of up to `made` other sentences a text with a
    made-up term in front. Equal differences are counted, not repeated, so what the driver holds is bounded by
    pairs of terms. A calibration on a tenth of the sample sets the final scale.
    Null labels and keys are left out; of a key labelled twice all rows count. Without labelled documents of both kinds
    the model scores every text as the share of toxic labels (0 if there are none).
    """
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y is not null")
    order = F.xxhash64(F.col("key").cast("string"))
    parts = [known.where(F.col("y") == y).orderBy(order, "key").limit(most // 2 if y else most) for y in (1, 0)]
    chosen = [(r["key"], r["y"]) for p in parts for r in p.collect()]
    toxic = [c for c in chosen if c[1]]
    chosen = toxic + [c for c in chosen if not c[1]][: most - len(toxic)]
    rate = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = rate.get(1, 0) / max(1, sum(rate.values()))
    if not toxic or len(toxic) == len(chosen):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    sample = spark.createDataFrame(chosen, f"key {kind}, y int")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for b in slices(batches, 4 << 20, "text"):
            keys, ys, texts = (b.column(c).to_pylist() for c in ("key", "y", "text"))
            own, pairs = [], []
            for k, t in zip(keys, texts, strict=True):
                own.append(features(t).tobytes())
                counted: Counter[bytes] = Counter()
                for one, two in (*swaps(t), *made_up(t, xxhash.xxh32_intdigest(str(k)), made)):
                    counted[_difference(features(one), features(two))] += 1
                pairs.append(sorted(counted.items()))
            kind = pa.list_(pa.struct([("change", pa.binary()), ("n", pa.int64())]))
            listed = [[{"change": c, "n": n} for c, n in p] for p in pairs]
            yield pa.record_batch([pa.array([str(k) for k in keys]), pa.array(ys, pa.int32()), pa.array(own, pa.binary()), pa.array(listed, kind)], ["key", "y", "own", "pairs"])

    joined = docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).join(F.broadcast(sample), "key")
    rows = sorted(joined.mapInArrow(featured, "key string, y int, own binary, pairs array<struct<change:binary,n:bigint>>").toLocalIterator(prefetchPartitions=True), key=lambda r: (xxhash.xxh64_intdigest(r["key"]), r["key"], bytes(r["own"])))
    if len({r["y"] for r in rows}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    y = np.array([r["y"] for r in rows], float)
    x = Sparse.of([np.frombuffer(r["own"], np.int32) for r in rows])
    held = np.arange(len(rows)) % 10 == 9
    counted: Counter[bytes] = Counter()
    for r in rows:
        for change, n in r["pairs"]:
            counted[bytes(change)] += n
    changes = sorted(counted)
    signed = [np.frombuffer(c, np.int32) for c in changes]
    keep = telling(x, y, 1 << BITS, z) >= 0
    keep[np.abs(np.concatenate([np.empty(0, np.int32), *signed])) - 1] = True
    new = np.where(keep, np.cumsum(keep) - 1, -1)
    width = int(keep.sum())
    x = x.kept(new)
    pairs = None
    if changes:
        both = Sparse.of([np.abs(c) - 1 for c in signed])
        pairs = Sparse(both.index, both.row, np.sign(np.concatenate(signed)).astype(float), both.rows).kept(new)
        share_of = np.array([counted[c] for c in changes], float)
        pairs.values *= np.sqrt(share_of * pairs.rows / share_of.sum())[pairs.row]  # so that the mean is over all pairs
    ratio = (y.mean() or 1) / max(1 - y.mean(), 1e-9)
    weight = np.where(y > 0, 1.0, ratio * (1 - share) / max(share, 1e-6))  # back to the labels' share of toxic rows
    fitted = ~held
    part = Sparse(x.index[fitted[x.row]], x.row[fitted[x.row]], x.values[fitted[x.row]], x.rows)
    w, bias = fit(part, y, width, weight=weight * fitted, pairs=pairs, pull=pull)
    scale, shift = platt((x.times(w) + bias)[held], y[held])
    scale, shift = max(scale, 1.0), float(np.clip(shift, -1.0, 1.0))
    weights = np.zeros(1 << BITS, np.float32)
    weights[new >= 0] = scale * w[new[new >= 0]]
    return Model(weights, scale * bias + shift)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of the toxic label for every whole text.

    The model is of fixed size and goes along with the task. Null and empty texts get the score of no features;
    rows and keys are kept as they come, equal texts get equal scores; an empty table gives no rows; no other column
    is read, so none can clash.
    """
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.flatnonzero(weights)
        known = dict(zip(told.tolist(), weights[told].astype(float).tolist(), strict=True))
        cache: dict[str, tuple[int, ...]] = {}
        for b in slices(batches, 4 << 20, "text"):
            if len(cache) > 300_000:
                cache.clear()
            out = []
            for t in b.column("text").to_pylist():
                words = set(t.split())
                for w in words.difference(cache):
                    cache[w] = tuple(f for f in _word_features(w) if f in known)
                found: set[int] = set()
                for f in filter(None, map(cache.__getitem__, words)):
                    found.update(f)
                out.append(bias + sum(known[f] for f in sorted(found)))
            yield pa.record_batch([b.column("key"), pa.array(sigmoid(np.array(out)))], ["key", "score"])
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, f"key {kind}, score double")
