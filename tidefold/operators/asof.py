"""State at an instant, at many instants, and at all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.spec import StateSpec


def dedup(events: DataFrame, spec: StateSpec) -> DataFrame:
    """Events without repeats of (sid, time, event_id): the first to arrive stays.

    The log is dealt by entity, which later operators on the same entities build on without another shuffle.
    """
    first = Window.partitionBy(spec.sid, spec.time, spec.event_id).orderBy(spec.arrival)
    return events.repartition(F.col(spec.sid)).withColumn("_arrived", F.row_number().over(first)).where("_arrived = 1").drop("_arrived")


def at(events: DataFrame, spec: StateSpec, instant: Column, ids: DataFrame | None = None, strict: bool = False, started: bool = False) -> DataFrame:
    """(sid, time, state..., found): each entity's state at `instant`.

    An entity with events but none before the instant is found, in its zero state; with `ids` (a table with the
    column sid) exactly those entities come out, found or not. `started` leaves entities without an earlier event
    out, so the instant is a filter of the scan instead of a condition on each aggregate. Events must be free of
    repeats (see `dedup`) unless the reducers don't mind.
    """
    within = spec.before(instant, strict)
    if ids is not None:
        wanted = ids.select(F.col(spec.sid)).distinct()
        events = events.join(wanted, spec.sid, "left_semi")
    folded = events.where(within).groupBy(spec.sid).agg(*spec.folds()) if started and ids is None else events.groupBy(spec.sid).agg(*spec.folds(within))
    folded = folded.withColumn("found", F.lit(True))
    if ids is not None:
        folded = wanted.join(folded, spec.sid, "left")
        for name, r in spec.reducers.items():
            folded = folded.withColumn(name, F.coalesce(name, r.zero))
        folded = folded.withColumn("found", F.coalesce("found", F.lit(False)))
    return folded.select(spec.sid, instant.alias(spec.time), *spec.reducers, "found")


def at_many(events: DataFrame, spec: StateSpec, queries: DataFrame, strict: bool = False) -> DataFrame:
    """(sid, time, state...) for every row of `queries` (columns sid and time), entities without events included.

    Queries join the log as rows of their own, placed before the first event they don't see, and one running
    window answers all of them: one shuffle, however many instants.
    """
    mark = F.lit(None).cast(events.schema[spec.event_id].dataType) if strict else F.col(spec.sid).cast(events.schema[spec.event_id].dataType)
    asked = queries.select(F.col(spec.sid), F.col(spec.time), mark.alias(spec.event_id), F.lit(0).alias("_event")).distinct()
    rows = events.withColumn("_event", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    line = Window.partitionBy(spec.sid).orderBy(F.col(spec.time), F.col(spec.event_id).asc_nulls_first(), "_event").rowsBetween(Window.unboundedPreceding, 0)
    states = [r.running(spec.key(), line, F.col("_event") == 1).alias(n) for n, r in spec.reducers.items()]
    return rows.select(spec.sid, spec.time, "_event", *states).where("_event = 0").drop("_event")


def timeline(events: DataFrame, spec: StateSpec) -> DataFrame:
    """Every event with the state it leads to and its number in the entity's timeline."""
    line = Window.partitionBy(spec.sid).orderBy(spec.time, spec.event_id)
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    states = [r.running(spec.key(), run).alias(n) for n, r in spec.reducers.items()]
    return events.select(spec.sid, spec.time, spec.event_id, F.row_number().over(line).cast("bigint").alias("event_number"), *states)
