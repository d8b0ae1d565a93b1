"""A quality classifier by co-training: a view of the text and a view of its metadata teach each other.

Features of every document are taken once and written as numbers; the rounds then score all of them. In each round
either view labels the unlabelled documents it is surest of, relative to its own distribution, and these join the
other view's training set for good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tidefold.llm.common import slices, text_of, trim
from tidefold.llm.linear import Sparse, fit, platt, sigmoid, telling
from tidefold.sources.checkpoints import written

BITS = 16
#: Below this, features are steps of measurements and always count; above, hashed words or values.
_FIXED = 256
_STEPS = (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
_SYMBOLS = "#*$%&|<>"
#: Standard errors by which a hashed feature must tell the labels apart: words are many, values of metadata few.
_TELLING = {"content": 4.0, "metadata": 0.0}
_UPPER = {ord(c): None for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_SIGNS = ".,;:!?\"'()[]{}" + _SYMBOLS


def _hashed(name: str) -> int:
    return _FIXED + xxhash.xxh32_intdigest(name) % ((1 << BITS) - _FIXED)


def content_features(text: str) -> list[int]:
    """Steps of shares over the whole text's words and signs, and its distinct words, hashed."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    windows = len(set(zip(words, words[1:], words[2:], strict=False)))
    shares = (
        sum(map(text.count, _SYMBOLS)) / size,
        text.count("!!") / n,
        (size - len(text.translate(_UPPER))) / size if text else 0,
        1 - windows / max(1, n - 2) if n > 2 else 0,
        1 - len(distinct) / n,
        min(1, size / n / 20),
    )
    out = [16 * k + i for k, v in enumerate(shares) for i, step in enumerate(_STEPS) if v > step]
    out.append(128 + min(31, len(words).bit_length()))
    out += {_hashed(w.strip(_SIGNS).lower()) for w in distinct}
    return out


def _half_powers(x: float) -> int:
    return round(2 * math.log2(x)) if x >= 1 else -1


def metadata_features(row: dict[str, object], text: str) -> list[int]:
    """Values of metadata columns, numbers by half powers of two, and the page's layout: lines, their lengths, equal and blank ones."""
    values = {k: f"n{_half_powers(float(v))}" if isinstance(v, int | float) and not isinstance(v, bool) else f"v{v}" for k, v in row.items() if v is not None}
    lines = text.split("\n")
    sizes = sorted(map(len, lines))
    layout = {
        "lines": _half_powers(len(lines)),
        "mean": _half_powers(len(text) / len(lines)),
        "longest": _half_powers(sizes[-1]),
        "median": _half_powers(sizes[len(sizes) // 2]),
        "equal": round(8 * (1 - len(set(lines)) / len(lines))),
        "blank": round(8 * (len(lines) - sum(map(bool, lines))) / len(lines)),
        "stops": round(8 * sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / len(lines)),
    }
    return sorted({_hashed(f"{k}={v}") for k, v in values.items()} | {_hashed(f"layout {k}={v}") for k, v in layout.items()})


@dataclass
class View:
    weights: np.ndarray  # 2 ** BITS, whatever the corpus
    bias: float

    def __call__(self, features: list[int]) -> float:
        return self.bias + float(self.weights[features].sum()) if features else self.bias


@dataclass
class Model:
    content: View
    metadata: View
    prior: float  # log-odds of good quality
    columns: tuple[str, ...]
    #: For each round what the views labelled: (by content: good, bad; by metadata: good, bad).
    flow: list[tuple[int, int, int, int]] = field(default_factory=list)


def _fitted(x: Sparse, y: np.ndarray, z: float, weight: np.ndarray) -> tuple[np.ndarray, float]:
    new = telling(x, y, 1 << BITS, z, both=True)
    new[:_FIXED] = np.where(np.bincount(x.index, minlength=1 << BITS)[:_FIXED] > 0, 0, -1)
    keep = new >= 0
    new = np.where(keep, np.cumsum(keep) - 1, -1)
    w, bias = fit(x.kept(new), y, int(keep.sum()), ridge=1e-3, weight=weight)
    weights = np.zeros(1 << BITS)
    weights[keep] = w
    return weights, bias


def features(docs: DataFrame, columns: tuple[str, ...], key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, content, metadata): both views' features of every whole text, as numbers, written to the checkpoint folder.

    With `carry`, `row` has the whole input row beside them, so that what is scored needs no join back to it.
    """
    read = _read(docs, key, text, columns, carry)
    kind = [read.schema["key"], StructField("content", ArrayType(IntegerType())), StructField("metadata", ArrayType(IntegerType()))]
    if carry:
        kind.append(read.schema["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20, "text"):
            rows = [b.column("row")] if carry else []
            yield pa.RecordBatch.from_arrays([b.column("key"), *_views(b), *rows], ["key", "content", "metadata", "row"][: 3 + carry])
        trim()

    return written(read.mapInArrow(run, StructType(kind)))


def _views(b: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """Both views' features of a batch's texts and metadata."""
    texts = b.column("text").to_pylist()
    own = [np.sort(np.array(content_features(t), np.int32)) for t in texts]
    meta = [np.array(metadata_features(m, t), np.int32) for m, t in zip(b.column("meta").to_pylist(), texts, strict=True)]
    return _lists(own), _lists(meta)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def _sums(lists: pa.ListArray, view: View) -> np.ndarray:
    """The view's score of each row."""
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return view.bias + np.bincount(owner, weights=view.weights[lists.flatten().to_numpy()], minlength=len(sizes))


def _scores(read: DataFrame, content: View, metadata: View, names: list[str]) -> DataFrame:
    """Columns `names` of `read` (which has both views' features) and the views' log-odds `s_content` and `s_metadata`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(_sums(b.column("content"), content)), pa.array(_sums(b.column("metadata"), metadata))], [*names, "s_content", "s_metadata"])

    return read.mapInArrow(run, StructType([*[read.schema[c] for c in names], StructField("s_content", DoubleType()), StructField("s_metadata", DoubleType())]))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("source", "lang", "n_chars"), most: int = 6000, rounds: int = 3, teach: int = 200, sure: float = 0.95, known: DataFrame | None = None
) -> Model:
    """Fit both views on at most `most` labelled rows (those with the smallest hash of their key), then co-train.

    Each of `rounds` rounds fits both views and scores every document. Of those without a label so far, each view
    labels up to `teach` as good and, in the labels' proportion, as bad: the ones it is surest of, and only where
    that share of its best (worst) scored held-out rows is right that `sure` asks for, so a view that can't tell a
    class doesn't teach it. They join the other view's training set for good and leave the unlabelled documents.
    A fifth of the labelled rows is kept apart, for that test and for the calibration of the two scores. Only
    feature numbers of labelled and taught rows come to the driver. `known`: what `features` gave for `docs`.
    Metadata columns that the table lacks are left out. Null labels and keys are left out, ties go by the key; of a
    key that is repeated each row counts; with labels of one kind only, the score is constant.
    """
    columns = tuple(c for c in metadata if c in docs.columns)
    given = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y is not null")
    order = F.xxhash64(F.col("key").cast("string"))
    labelled = given.orderBy(order, "key", "y").limit(most).collect()
    ones = sum(r["y"] == 1 for r in labelled)
    prior = float(np.log((ones + 0.5) / (len(labelled) - ones + 0.5)))
    flat = View(np.zeros(1 << BITS), prior)
    if not 0 < ones < len(labelled):
        return Model(flat, flat, prior, columns)
    every = (features(docs, columns, key, text) if known is None else known).select("key", "content", "metadata")
    kind = docs.schema[key].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame([(r["key"], r["y"]) for r in labelled], f"key {kind}, y int")
    rows = every.join(F.broadcast(sample), "key").select(F.col("key").cast("string").alias("key"), "y", "content", "metadata").toArrow().to_pylist()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r["key"]), r["key"], r["content"], r["y"]))
    if len({r["y"] for r in rows}) < 2:
        return Model(flat, flat, prior, columns)
    held = [r for k, r in enumerate(rows) if k % 5 == 4]
    own = [r for k, r in enumerate(rows) if k % 5 != 4]
    truth = np.array([r["y"] for r in held], float)
    views = ("content", "metadata")
    taught: dict[str, list[dict]] = {v: [] for v in views}  # to the view, by the other
    free = every.join(F.broadcast(sample.select("key")), "key", "left_anti").where("key is not null")
    flow: list[tuple[int, int, int, int]] = []
    models, checks = {}, {}
    gone: set[str] = set()
    for turn in range(rounds + 1):
        for v in views:
            train_rows = [*own, *taught[v]]
            x, y = Sparse.of([np.array(r[v], np.int64) for r in train_rows]), np.array([r["y"] for r in train_rows], float)
            weight = np.array([r.get("weight", 1.0) for r in train_rows])
            models[v] = View(*_fitted(x, y, _TELLING[v], weight))
            checks[v] = _sums(_lists([np.array(r[v], np.int32) for r in held]), models[v])
        if turn == rounds:
            break
        # what each view may label: (view, its pupil, label, bound, most)
        jobs = []
        for v, other in (views, views[::-1]):
            for good in (1, 0):
                share = ones / len(labelled) if good else 1 - ones / len(labelled)
                bound = _bound(checks[v], truth, good, sure)
                most_ = max(1, round(teach * min(1.0, share / max(1e-9, 1 - share)))) if bound is not None else 0
                jobs.append((v, other, good, bound, most_))
        surest = _surest(free, models, jobs, gone)
        counts = []
        for (_, other, good, _, most_), found in zip(jobs, surest, strict=True):
            new = [r | {"y": good, "weight": 0.5} for r in found if r["key"] not in gone][:most_]
            gone |= {r["key"] for r in new}
            taught[other] += new
            counts.append(len(new))
        flow.append(tuple(counts))
        if not sum(counts):
            break
    out = []
    for v in views:
        a, c = platt(checks[v], truth)
        out.append(View(a * models[v].weights, a * models[v].bias + c))
    return Model(out[0], out[1], prior, columns, flow)


def _surest(free: DataFrame, models: dict[str, View], jobs: list[tuple], gone: set[str]) -> list[list[dict]]:
    """For each job the rows (key, content, metadata) its view is surest of, enough of them that other jobs' picks can go.

    One pass over the features ranks keys by score for all jobs together, a second fetches what was ranked. Ranks are
    taken in groups of tasks first, so the last one sees few rows however many tasks there are.
    """
    need = sum(job[4] for job in jobs)
    if not need:
        return [[] for _ in jobs]
    spark, name = free.sparkSession, F.col("key").cast("string")
    if gone:
        taken = spark.createDataFrame([(k,) for k in sorted(gone)], "taken string")
        free = free.join(F.broadcast(taken), name == F.col("taken"), "left_anti")
    signed = [F.col(f"s_{v}") * (1 if good else -1) for v, _, good, _, _ in jobs]
    offers = [F.when(own >= F.lit(bound if good else -bound), F.struct(F.lit(j).alias("job"), own.alias("own"))) for j, (own, (_, _, good, bound, _)) in enumerate(zip(signed, jobs, strict=True)) if bound is not None]
    ranked = _scores(free, models["content"], models["metadata"], ["key"]).select(name.alias("key"), F.explode(F.array_compact(F.array(*offers))).alias("offer"))
    # a repeated key takes one place
    ranked = ranked.groupBy("offer.job", "key").agg(F.max("offer.own").alias("own")).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(256)))
    for within in (("job", "group"), ("job",)):
        order = Window.partitionBy(*within).orderBy(F.desc("own"), F.xxhash64("key"), "key")
        ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= need)
    places = {(r["job"], r["key"]): r["place"] for r in ranked.collect()}
    chosen = spark.createDataFrame(list(places), "job int, chosen string")
    rows = _scores(free.join(F.broadcast(chosen.select("chosen").distinct()), name == F.col("chosen")), models["content"], models["metadata"], ["key", "content", "metadata"])
    own = F.element_at(F.array(*signed), F.col("job") + 1)
    best = rows.join(F.broadcast(chosen), name == F.col("chosen")).groupBy("job", "chosen").agg(F.max(F.struct(own.alias("own"), "content", "metadata")).alias("r"))
    out: list[list[dict]] = [[] for _ in jobs]
    for r in best.select("job", F.col("chosen").alias("key"), "r.content", "r.metadata").toArrow().to_pylist():
        out[r.pop("job")].append(r)
    for j, found in enumerate(out):
        found.sort(key=lambda r, j=j: places[j, r["key"]])
    return out


def _bound(scores: np.ndarray, truth: np.ndarray, good: int, sure: float) -> float | None:
    """The widest score from which on (for bad: down from which) a share of `sure` of the held-out rows is right; None if fewer than 5 are."""
    order = np.argsort(-scores if good else scores, kind="stable")
    right = np.cumsum(truth[order] == good) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero((right >= sure) & (np.arange(1, len(order) + 1) >= 5))
    return float(scores[order[ok[-1]]]) if len(ok) else None


def _read(docs: DataFrame, key: str, text: str, columns: tuple[str, ...], carry: bool) -> DataFrame:
    meta = F.struct(*[docs[c].alias(c) for c in columns]) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text"), meta.alias("meta"), *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry)


def _combined(one: np.ndarray, two: np.ndarray, prior: float) -> np.ndarray:
    return sigmoid(one + two - prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, score, p_content, p_metadata): calibrated views and their combination for every whole text.

    The views' log-odds add up, less the prior that both contain. Null texts are empty, null metadata has no
    feature; rows and keys are kept as they come; an empty table gives no rows; clashing names can't occur, as only
    the named columns are read. `known`: what `features` gave for `docs`.
    """
    every = features(docs, model.columns, key, text) if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _sums(b.column("content"), model.content), _sums(b.column("metadata"), model.metadata)
            yield pa.record_batch([b.column("key"), *map(pa.array, (_combined(one, two, model.prior), sigmoid(one), sigmoid(two)))], ["key", "score", "p_content", "p_metadata"])

    kind = docs.schema[key].dataType.simpleString()
    return every.mapInArrow(run, f"key {kind}, score double, p_content double, p_metadata double")


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score", known: DataFrame | None = None) -> DataFrame:
    """`docs` with all its columns and the combined score in `into` (an input column of that name is replaced).

    The input travels in a struct, so its names can't clash with any used here. Rows as for `score`. `known`: what
    `features` gave for `docs` with `carry`; its rows are those returned.
    """
    rest, fresh = docs.drop(into), known is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20, "text") if fresh else batches:
            content, metadata = _views(b) if fresh else (b.column("content"), b.column("metadata"))
            both = _combined(_sums(content, model.content), _sums(metadata, model.metadata), model.prior)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(both)], ["row", "score"])
        trim()

    if fresh:
        meta = F.struct(*[rest[c].alias(c) for c in model.columns]) if model.columns else F.struct(F.lit(None).cast("string").alias("none"))
        read = rest.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), text_of(rest, text).alias("text"), meta.alias("meta"))
    else:
        read = known.select("row", "content", "metadata")
    out = read.mapInArrow(run, StructType([read.schema["row"], StructField("score", DoubleType())]))
    return out.select(*[F.col("row")[c].alias(c) for c in rest.columns], F.col("score").alias(into))
