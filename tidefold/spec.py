"""What a timeline is made of: which columns identify entities and events, and how events fold into state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.functions.reducers import Reducer


@dataclass(frozen=True)
class StateSpec:
    """Columns of an event log and the reducers that make up an entity's state.

    sid: entity; time: event time (any ordered type); event_id: unique within (sid, time); arrival: order in which
    events came in, needed only where arrival matters (duplicates, notifications). reducers: state column to reducer.
    """

    sid: str = "snapshot_id"
    time: str = "time"
    event_id: str = "event_id"
    arrival: str = "arrival_seq"
    reducers: dict[str, Reducer] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = (self.sid, self.time, self.event_id)
        if len({*names}) < 3:
            raise ValueError("sid, time and event_id must be different columns")
        if taken := {*names, "found", "event_number"} & {*self.reducers}:
            raise ValueError(f"state columns must have names of their own: {sorted(taken)}")

    def before(self, instant: Column, strict: bool = False) -> Column:
        """Events that state at `instant` includes: earlier ones and, unless strict, those at the instant whose id is below the entity's.

        Written so that the bound on time alone reaches the scan.
        """
        if strict:
            return F.col(self.time) < instant
        return (F.col(self.time) <= instant) & ((F.col(self.time) < instant) | (F.col(self.event_id) < F.col(self.sid)))

    def key(self) -> Column:
        """(time, event_id), ordered as timelines are."""
        return F.struct(F.col(self.time).alias("time"), F.col(self.event_id).alias("id"))

    def folds(self, when: Column | None = None) -> list[Column]:
        """The state columns as aggregates over a group's events, those only for which `when` holds."""
        return [r.grouped(self.key(), when).alias(name) for name, r in self.reducers.items()]
