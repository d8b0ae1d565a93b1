"""Which ranges of time late data and snapshots have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.spec import StateSpec

CAPACITY = 1000


def _arrived(spec: StateSpec):
    return Window.partitionBy(spec.sid).orderBy(spec.arrival).rowsBetween(Window.unboundedPreceding, -1)


def reconciliations(events: DataFrame, spec: StateSpec) -> DataFrame:
    """(sid, arrival, from_time, to_time): one row for each event that came after a later one, repeats included.

    The range runs from the event's time to the latest time known before it arrived. Every reader sees every row,
    with its own offset (the arrival).
    """
    latest = events.withColumn("to_time", F.max(spec.time).over(_arrived(spec)))
    return latest.where(F.col(spec.time) < F.col("to_time")).select(spec.sid, spec.arrival, F.col(spec.time).alias("from_time"), "to_time")


def snapshot_reconciliations(events: DataFrame, snapshots: DataFrame, spec: StateSpec) -> DataFrame:
    """(sid, arrival, from_time, to_time): one row for each authoritative snapshot of an entity that already has a history.

    The range runs to the latest event known when the snapshot arrived, or to the snapshot's own time if there is
    none; it may run backwards for a snapshot newer than all events.
    """
    columns = (spec.sid, spec.arrival, spec.time)
    log = events.select(*columns, F.lit(False).alias("_snapshot")).unionByName(snapshots.select(*columns, F.lit(True).alias("_snapshot")))
    seen = log.withColumn("_latest", F.max(F.when(~F.col("_snapshot"), F.col(spec.time))).over(_arrived(spec))).withColumn("_before", F.count("*").over(_arrived(spec)))
    return seen.where("_snapshot AND _before > 0").select(spec.sid, spec.arrival, F.col(spec.time).alias("from_time"), F.coalesce("_latest", spec.time).alias("to_time"))


def capacity(changes: DataFrame, spec: StateSpec, most: int = CAPACITY) -> DataFrame:
    """What a reader who never drains receives: the first `most` changes of each entity, the newer ones dropped."""
    order = Window.partitionBy(spec.sid).orderBy(spec.arrival)
    return changes.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")
