"""One log, several types of state: which events fold into which lane, and each lane's own state out again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.asof import at as state_at
from tidefold.spec import StateSpec


@dataclass(frozen=True)
class Lanes:
    """lanes: name to (spec of its state, entity key over an event's columns, condition or None), in order.

    An event targets each lane whose condition holds (or is None) and whose key is not null; other pairs are no-ops.
    Entity ids are a lane's own: results carry the lane beside them, so equal ids of two lanes stay apart.
    """

    lanes: dict[str, tuple[StateSpec, Column, Column | None]]

    def _when(self, name: str) -> Column:
        _, key, condition = self.lanes[name]
        return key.isNotNull() & (F.lit(True) if condition is None else F.coalesce(condition, F.lit(False)))

    def events(self, log: DataFrame, name: str) -> DataFrame:
        """The events of one lane, with their entity in the spec's sid column (an input column of that name is replaced)."""
        spec, key, _ = self.lanes[name]
        return log.where(self._when(name)).withColumn(spec.sid, key.cast("bigint"))

    def at(self, log: DataFrame, instant: Column) -> DataFrame:
        """(lane, sid, found, one struct of state a lane): every lane's states at `instant`; a row has its own lane's struct.

        One scan and one pre-aggregated shuffle a lane. Events must be free of repeats, as for `operators.at`.
        """
        out = None
        for name in self.lanes:
            spec = self.lanes[name][0]
            states = state_at(self.events(log, name), spec, instant)
            row = states.select(F.lit(name).alias("lane"), F.col(spec.sid).alias("sid"), "found", F.struct(F.col(spec.time).alias("time"), *spec.reducers).alias(f"state_{name}"))
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
        return out

    def lane(self, states: DataFrame, name: str) -> DataFrame:
        """(sid, time, state..., found): the typed states of one lane, out of what `at` returns."""
        return states.where(F.col("lane") == name).select("sid", f"state_{name}.*", "found")

    def first_target(self, log: DataFrame) -> DataFrame:
        """The log with the lane and sid of each event's first target, in the order of the lanes; null without any."""
        none = F.lit(None).cast("struct<lane:string,sid:bigint>")
        targets = [F.when(self._when(n), F.struct(F.lit(n).alias("lane"), key.cast("bigint").alias("sid"))) for n, (_, key, _) in self.lanes.items()]
        rest, first = [c for c in log.columns if c not in ("lane", "sid")], F.coalesce(*targets, none)
        return log.select(*rest, first["lane"].alias("lane"), first["sid"].alias("sid"))
