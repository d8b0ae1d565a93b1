"""Stored states: checkpoints that speed queries up, authoritative snapshots that override, and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.asof import timeline
from tidefold.spec import StateSpec

INTERVAL = 100


def checkpoints(events: DataFrame, spec: StateSpec, interval: int = INTERVAL) -> DataFrame:
    """(sid, time, event_id, event_number, state...): the state after every `interval`-th event of each timeline."""
    if interval < 1:
        raise ValueError("interval must be at least 1")
    return timeline(events, spec).where(F.col("event_number") % interval == 0)


def at_from_checkpoints(events: DataFrame, marks: DataFrame, spec: StateSpec, instant: Column) -> DataFrame:
    """(sid, time, state...): as `at`, folding only the events after the entity's last checkpoint up to the instant."""
    reach = (F.col(spec.time) < instant) | ((F.col(spec.time) == instant) & (F.col(spec.event_id) <= F.col(spec.sid)))
    base = marks.where((F.col(spec.time) <= instant) & reach).groupBy(spec.sid).agg(F.max_by(F.struct("*"), spec.key()).alias("_mark"))
    later = F.col("_mark").isNull() | (spec.key() > F.struct(F.col(f"_mark.{spec.time}"), F.col(f"_mark.{spec.event_id}")))
    joined = events.join(base, spec.sid, "left")
    tail = joined.groupBy(spec.sid).agg(F.first("_mark").alias("_mark"), *spec.folds(later & spec.before(instant)))
    states = [F.when(F.col("_mark").isNull(), F.col(n)).otherwise(r.combine(F.col(f"_mark.{n}"), F.col(n))).alias(n) for n, r in spec.reducers.items()]
    return tail.select(spec.sid, instant.alias(spec.time), *states)


def override_at(events: DataFrame, snapshots: DataFrame, spec: StateSpec, instant: Column) -> DataFrame:
    """(sid, time, state...): the last authoritative snapshot up to `instant`, and the events after it, folded on top.

    snapshots: sid, time and the state columns. A snapshot takes in the events at its own time whose id is not above
    the entity's. Entities known from either table are found.
    """
    base = snapshots.groupBy(spec.sid).agg(F.max_by(F.when(F.col(spec.time) <= instant, F.struct("*")), F.when(F.col(spec.time) <= instant, F.col(spec.time))).alias("_mark"))
    joined = events.join(base, spec.sid, "full_outer")
    at = F.col(f"_mark.{spec.time}")
    later = F.col("_mark").isNull() | (F.col(spec.time) > at) | ((F.col(spec.time) == at) & (F.col(spec.event_id) > F.col(spec.sid)))
    tail = joined.groupBy(spec.sid).agg(F.first("_mark").alias("_mark"), *spec.folds(later & spec.before(instant)))
    states = [F.when(F.col("_mark").isNull(), F.col(n)).otherwise(r.combine(F.col(f"_mark.{n}"), F.col(n))).alias(n) for n, r in spec.reducers.items()]
    return tail.select(spec.sid, instant.alias(spec.time), *states)


def _numbered(events: DataFrame, spec: StateSpec, drop: Column, interval: int) -> DataFrame:
    """Events with their number, the number of events before the horizon, and how many of these a checkpoint keeps."""
    line = Window.partitionBy(spec.sid).orderBy(spec.time, spec.event_id)
    whole = Window.partitionBy(spec.sid)
    dropped = F.count(F.when(F.col(spec.time) < drop, 1)).over(whole)
    numbered = events.withColumn("_n", F.row_number().over(line).cast("bigint")).withColumn("_dropped", dropped)
    return numbered.withColumn("_based", F.col("_dropped") - F.col("_dropped") % interval)


def prune_at(events: DataFrame, spec: StateSpec, drop: Column, instant: Column, interval: int = INTERVAL) -> DataFrame:
    """(sid, time, state...): the state at `instant` once everything before `drop` has been pruned.

    Pruning keeps the state of the last checkpoint before the horizon as the new base; events between that
    checkpoint and the horizon are lost, unless a checkpoint kept after the horizon already holds them.
    """
    before = spec.before(instant)
    rows = _numbered(events, spec, drop, interval)
    kept = (F.col("_n") > F.col("_dropped")) & (F.col("_n") % interval == 0) & (before | ((F.col(spec.time) == instant) & (F.col(spec.event_id) == F.col(spec.sid))))
    whole = F.max(kept).over(Window.partitionBy(spec.sid))
    seen = F.when(F.col("_whole"), before).otherwise((F.col("_n") <= F.col("_based")) | ((F.col("_n") > F.col("_dropped")) & before))
    return rows.withColumn("_whole", whole).groupBy(spec.sid).agg(*spec.folds(seen)).select(spec.sid, instant.alias(spec.time), *spec.reducers)


def retained(events: DataFrame, spec: StateSpec, drop: Column, interval: int = INTERVAL) -> DataFrame:
    """(sid, kept_events, dropped_events, kept_checkpoints, based_on): what pruning at `drop` leaves of each timeline."""
    rows = _numbered(events, spec, drop, interval)
    kept = F.col("_n") > F.col("_dropped")
    count = lambda when: F.count(F.when(when, 1))
    return rows.groupBy(spec.sid).agg(
        count(kept).alias("kept_events"), F.max("_dropped").alias("dropped_events"), count(kept & (F.col("_n") % interval == 0)).alias("kept_checkpoints"), F.max("_based").alias("based_on")
    )
