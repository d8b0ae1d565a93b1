"""A uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidefold.sources.checkpoints import checkpointed

#: Rows of a block, about: what of a shard is ordered together.
BLOCK_ROWS = 1 << 14
#: numpy draws hypergeometric numbers exactly for populations below this.
_NUMPY_LIMIT = 1_000_000_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart that add up to `rows`."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    lowest, highest = max(0, draws - bad), min(draws, good)
    middle, spread = draws * good / total, math.sqrt(draws * good / total * bad / total * (total - draws) / (total - 1))
    k = np.arange(max(lowest, int(middle - 40 * spread - 2)), min(highest, int(middle + 40 * spread + 2)) + 1, dtype=np.float64)
    up = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    weight = np.concatenate(([0.0], np.cumsum(up)))
    mass = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(mass, rng.random() * mass[-1], side="right"), len(k) - 1)])


def _multivariate(rng: np.random.Generator, colours: np.ndarray, draws: int) -> np.ndarray:
    """How many of each colour a sample without replacement of `draws` balls holds."""
    left = int(colours.sum())
    if left < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(colours, draws, method="marginals")
    out = np.zeros_like(colours)
    for i, c in enumerate(colours.tolist()):
        left -= c
        out[i] = _hypergeometric(rng, c, left, draws) if draws else 0
        draws -= int(out[i])
    return out


def matrix_row(part: int, before: np.ndarray, colours: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix with row sums diff(before) and column sums `colours`.

    The matrix is drawn by halving the partitions: each node of that binary tree splits its column counts
    between its halves with a multivariate hypergeometric draw, seeded by the node. So every task finds its own
    row with a logarithmic number of draws, all tasks agree, and no one holds the whole matrix.
    """
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _multivariate(np.random.default_rng([seed, lo, hi]), colours, int(before[mid] - before[lo]))
        lo, hi, colours = (lo, mid, left) if part < mid else (mid, hi, colours - left)
    return colours


def _stable(df: DataFrame) -> DataFrame:
    """A frame whose partitions hold the same rows each time: a plain scan as it is, all else by way of a checkpoint."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    moving = df.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    return checkpointed(df) if moving or any(x in plan for x in ("Exchange", "Adaptive", "Sample", "LocalTable", "Range", "MapIn", "PythonUDF")) else df


def hypergeometric_shuffle(df: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of `df`, with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard), uniformly shuffled.

    Shard sizes are exact and at most one apart. A count of each partition's rows is all that comes to the driver.
    Then, per partition, its row of the hypergeometric matrix says how many rows go to each shard: one colour a shard,
    so a draw costs the same for any number of rows. Rows take these places in random order as they stream by (batch
    by batch: counts drawn, labels permuted), each with a random number of 63 bits, and one exchange by
    shard and block moves them. Within a shard the order of independent random numbers is a uniform permutation
    (ties, by place of origin, have a chance of rows ** 2 / 2 ** 64), so a shard of any size is cut into `blocks` of
    about `block_rows` rows, which many tasks order; a block's first slot follows from the blocks' counts, which are
    added up by Spark. The same seed and partitions give the same result, also when a lost task runs again; if a
    partition's rows change between the two readings, the job fails instead of misplacing.

    Rows count as they come: nulls, empty or repeated rows are rows like others; with fewer rows than shards some
    shards are empty; an empty table gives no rows. The input travels in a struct, so its names can't clash with any
    used here; input columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    source = _stable(df.select(F.struct(*[df[c] for c in kept]).alias("row") if kept else F.struct(F.lit(1).alias("none")).alias("row")))
    counts = {r["p"]: r["n"] for r in source.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = max(counts, default=0) + 1
    before = np.concatenate(([0], np.cumsum([counts.get(p, 0) for p in range(parts)]))).astype(np.int64)
    rows = int(before[-1])
    colours = np.array(shard_sizes(rows, shards), np.int64)
    blocks = max(1, math.ceil(rows / shards / block_rows))  # of each shard, by equal ranges of the random number
    width = min((1 << 63) // blocks + 1, (1 << 63) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = left = None
        part, seen = -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            if left is None:
                part = b.column("part")[0].as_py()
                left, rng = matrix_row(part, before, colours, seed).copy(), np.random.default_rng([seed, part])
            if int(left.sum()) < b.num_rows:
                raise RuntimeError("a source partition grew between its count and its shuffle")
            take = _multivariate(rng, left, b.num_rows)
            left -= take
            shard = np.repeat(np.arange(len(take)), take)
            rng.shuffle(shard)
            order = rng.integers(0, (1 << 63) - 1, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(shard), pa.array(order // width), pa.array(order), pa.array(np.arange(seen, seen + b.num_rows))], ["row", "part", "shard", "block", "order", "number"])
            seen += b.num_rows
        if left is not None and left.any():
            raise RuntimeError("a source partition shrank between its count and its shuffle")

    marked = source.select("row", F.spark_partition_id().alias("part"))
    schema = StructType(list(marked.schema))
    for name in ("shard", "block", "order", "number"):
        schema = schema.add(name, LongType())
    placed = marked.mapInArrow(place, schema)
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("order", "part", "number"))
    if blocks == 1:
        named = placed.select("row", F.col("shard").cast("int").alias("shard"), (rank - 1).cast("bigint").alias("slot"))
    else:
        # counts of the blocks, drawn again from the same seeds: no row is read twice for them but by its number
        sizes = checkpointed(placed.groupBy("shard", "block").agg(F.count("*").alias("n")))
        first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select(F.col("shard").alias("s"), F.col("block").alias("b"), first.alias("first"))
        ranked = placed.withColumn("rank", rank)
        joined = ranked.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
        named = joined.select("row", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot"))
    return named.select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot")
