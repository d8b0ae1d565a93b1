"""Events with several targets, placement, and the memory budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.spec import StateSpec

#: Entity ids of lane n start at n * 2 ** 40, so that lanes never share an id.
LANE = 1 << 40


def fan_out(events: DataFrame, lanes: dict[str, Column], sid: str = "snapshot_id", when: dict[str, Column] | None = None) -> DataFrame:
    """Each event once for every lane it targets, with `lane` and the lane's own entity id in `sid`.

    lanes: name to key column, in order; a null key targets nothing, nor does a lane whose `when` doesn't hold.
    """
    targets = []
    for n, (name, key) in enumerate(lanes.items()):
        wanted = key.isNotNull() & (when or {}).get(name, F.lit(True))
        targets.append(F.when(wanted, F.struct(F.lit(name).alias("lane"), (F.lit(n * LANE) + key.cast("bigint")).alias("id"))))
    return events.withColumn("_target", F.explode(F.array_compact(F.array(*targets)))).withColumn("lane", F.col("_target.lane")).withColumn(sid, F.col("_target.id")).drop("_target")


def partition_counts(events: DataFrame, spec: StateSpec, partitions: int, by: Column | None = None) -> DataFrame:
    """(partition, entities, events): how a log is dealt to partitions by a number of its entities, their hash unless `by` says otherwise."""
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    each = events.groupBy(spec.sid).agg(F.count("*").alias("n"))
    return each.groupBy(F.pmod(F.xxhash64(spec.sid) if by is None else by, F.lit(partitions)).cast("bigint").alias("partition")).agg(F.count("*").alias("entities"), F.sum("n").alias("events"))


def memory_usage(events: DataFrame, spec: StateSpec, event_bytes: Column, state_bytes: Column, base_bytes: int, interval: int = 100) -> DataFrame:
    """(sid, event_bytes, checkpoint_bytes, base_bytes, total_bytes): conservative sizes of what is held for each entity.

    event_bytes is over an event's columns, state_bytes over a checkpoint's.
    """
    from tidefold.operators.marks import checkpoints

    held = events.groupBy(spec.sid).agg(F.sum(event_bytes).cast("bigint").alias("event_bytes"))
    marks = checkpoints(events, spec, interval).groupBy(spec.sid).agg(F.sum(state_bytes).cast("bigint").alias("checkpoint_bytes"))
    rows = held.join(marks, spec.sid, "left").withColumn("checkpoint_bytes", F.coalesce("checkpoint_bytes", F.lit(0).cast("bigint"))).withColumn("base_bytes", F.lit(base_bytes).cast("bigint"))
    return rows.withColumn("total_bytes", F.col("event_bytes") + F.col("checkpoint_bytes") + F.col("base_bytes"))


def admit(events: DataFrame, spec: StateSpec, budget: int, event_bytes: int, base_bytes: int, interval: int = 100, parts: int | None = None) -> DataFrame:
    """The log in order of arrival, with `usage` before each event and whether it is `admitted` to a budget in bytes.

    For events of one size from a single writer: an event is refused once usage plus its size reaches the budget,
    and then so are all later ones. An entity's first event adds its base state, every `interval`-th a checkpoint.
    The running sum is global but no single task: quantiles of the (numeric) arrival cut the log into at most `parts`
    ranges (the shuffle partitions unless given), each sums its own rows, and their totals (one row each) are carried over.
    """
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy(spec.sid).orderBy(spec.arrival))
    cost = F.lit(event_bytes) + F.when(place == 1, base_bytes).otherwise(0) + F.when(place % interval == 0, base_bytes).otherwise(0)
    cuts = sorted({*events.approxQuantile(spec.arrival, [k / parts for k in range(1, parts)], 0.01)})
    ranges = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(spec.arrival))) if cuts else F.lit(0)
    dealt = events.withColumn("_cost", cost.cast("bigint")).withColumn("_part", ranges)
    own = F.sum("_cost").over(Window.partitionBy("_part").orderBy(spec.arrival).rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("_part").agg(F.sum("_cost").alias("_total"))
    carried = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    rows = dealt.withColumn("usage", F.coalesce(own, F.lit(0))).join(F.broadcast(carried), "_part").withColumn("usage", (F.col("usage") + F.col("_carried")).cast("bigint"))
    return rows.withColumn("admitted", F.col("usage") + event_bytes < budget).drop("_cost", "_part", "_carried")
