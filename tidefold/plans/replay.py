"""A command log run through the machine, entity by entity, in order of arrival."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.plans.machine import Fold, Timeline, opened

#: The command log: op is event, snapshot, advance or query. value is an event's payload or a snapshot's state; delta
#: is an advance's. Advances reach the entities that exist when they arrive (see `with_advances`).
COMMANDS = "seq bigint, op string, snapshot_id bigint, time bigint, event_id bigint, value bigint, delta bigint"
RESULTS = "seq bigint, kind string, snapshot_id bigint, time bigint, from_time bigint, to_time bigint, state bigint, found boolean"


def signed_sum() -> Fold:
    """State and payload are longs; the state is their sum."""
    return Fold(start=lambda _: 0, step=lambda state, value: state + value)


_BROADCAST_ADVANCES = 100_000


def with_advances(commands: DataFrame) -> DataFrame:
    """Advances without an entity dealt to every entity whose first command other than a query came before; all else as it is."""
    known = commands.where("op IN ('event', 'snapshot')").groupBy("snapshot_id").agg(F.min("seq").alias("_first"))
    moves = commands.where("op = 'advance' AND snapshot_id IS NULL").drop("snapshot_id")
    # one row an entity and advance, as each entity's timeline must see them; few advances go along with the tasks
    if moves.limit(_BROADCAST_ADVANCES + 1).count() <= _BROADCAST_ADVANCES:
        moves = F.broadcast(moves)
    each = known.join(moves, F.col("seq") > F.col("_first")).drop("_first")
    return commands.where("op <> 'advance' OR snapshot_id IS NOT NULL").unionByName(each)


def apply(line: Timeline | None, row: dict, fold: Fold, horizon: int, interval: int) -> tuple[Timeline | None, tuple | None]:
    """One command on one entity's timeline (None before its first): the timeline and a result row, if there is one."""
    sid, op = row["snapshot_id"], row["op"]
    change = None
    if op == "query":
        found = line is not None
        return line, (row["seq"], "query", sid, row["time"], None, None, line.at(row["time"]) if found else None, found)
    if op == "event":
        if line is None:
            line, _ = opened(sid, fold, horizon, interval)
        _, change = line.event(row["time"], row["event_id"], row.get("value"))
    elif op == "snapshot":
        if line is None:
            line, _ = opened(sid, fold, horizon, interval, snapshot=row.get("value"))
        else:
            _, change = line.snapshot(sid, row["time"], row.get("value"))
    elif op == "advance":
        if line is not None:
            line.advance(row["delta"])
    else:
        raise ValueError(f"unknown op {op!r}")
    return line, change and (row["seq"], "change", sid, None, change.from_time, change.to_time, None, None)


#: RESULTS as Arrow knows it.
_ARROW = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in RESULTS.split(", ")])


def results(rows: list[tuple]) -> pa.RecordBatch:
    """Result rows as Arrow: numbers never pass through floating point."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def run_log(batches: Iterable[pa.RecordBatch], fold: Fold, horizon: int, interval: int) -> Iterator[pa.RecordBatch]:
    """Results of a log sorted by entity and seq; one timeline is held at a time."""
    line, now = None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if row["snapshot_id"] != now:  # the entity before is done
                line, now = None, row["snapshot_id"]
            line, result = apply(line, row, fold, horizon, interval)
            if result:
                out.append(result)
        yield results(out)


def replay(commands: DataFrame, fold: Fold | None = None, horizon: int = 0, interval: int = 100) -> DataFrame:
    """Results of the log's queries and the changes its late events and snapshots report (RESULTS).

    One shuffle by entity; within an entity commands run in order of seq. A fold without a merge can't be split, so
    one entity is one task; its rows arrive in batches and only its timeline is held.
    """
    fold = fold or signed_sum()
    return with_advances(commands).repartition("snapshot_id").sortWithinPartitions("snapshot_id", "seq").mapInArrow(lambda it: run_log(it, fold, horizon, interval), RESULTS)
