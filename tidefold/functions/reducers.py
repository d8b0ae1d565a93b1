"""Reducers: how the events of one entity, in key order, fold into one state column.

Each has a grouped form (an aggregate), a running form (over a window in key order) and, where two folds can be put
together, a combined form. Sum, Count, Min, Max and Last are pre-aggregated before the shuffle; Append and ExprFold
depend on the order and gather one entity's events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _if(when: Column | None, value: Column) -> Column:
    return value if when is None else F.when(when, value)


class Reducer:
    """Base of all reducers; `zero` is the state before any event."""

    zero: Column

    def grouped(self, key: Column, when: Column | None = None) -> Column:
        return F.coalesce(self._aggregate(key, when), self.zero)

    def running(self, key: Column, window: WindowSpec, when: Column | None = None) -> Column:
        return F.coalesce(self._aggregate(key, when, window), self.zero)

    def combine(self, base: Column, tail: Column) -> Column:
        """The state after `tail`'s events on top of state `base`."""
        raise NotImplementedError(f"{type(self).__name__} cannot continue from a stored state")

    def _aggregate(self, key: Column, when: Column | None, window: WindowSpec | None = None) -> Column:
        raise NotImplementedError


def expression(value: Column | str) -> Column:
    """A column, or SQL text made one when it is used (so that specs can be declared before there is a session)."""
    return F.expr(value) if isinstance(value, str) else value


def _over(column: Column, window: WindowSpec | None) -> Column:
    return column if window is None else column.over(window)


@dataclass(frozen=True)
class Sum(Reducer):
    """Sum of a long expression."""

    value: Column | str

    @property
    def zero(self) -> Column:
        return F.lit(0).cast("bigint")

    def _aggregate(self, key, when, window=None):
        return _over(F.sum(_if(when, expression(self.value))), window).cast("bigint")

    def combine(self, base, tail):
        return base + tail


@dataclass(frozen=True)
class Count(Reducer):
    """Number of events."""

    @property
    def zero(self) -> Column:
        return F.lit(0).cast("bigint")

    def _aggregate(self, key, when, window=None):
        return _over(F.count(_if(when, F.lit(1))), window)

    def combine(self, base, tail):
        return base + tail


@dataclass(frozen=True)
class Min(Reducer):
    value: Column | str

    @property
    def zero(self) -> Column:
        return F.lit(None)

    def _aggregate(self, key, when, window=None):
        return _over(F.min(_if(when, expression(self.value))), window)

    def combine(self, base, tail):
        return F.least(base, tail)


@dataclass(frozen=True)
class Max(Reducer):
    value: Column | str

    @property
    def zero(self) -> Column:
        return F.lit(None)

    def _aggregate(self, key, when, window=None):
        return _over(F.max(_if(when, expression(self.value))), window)

    def combine(self, base, tail):
        return F.greatest(base, tail)


@dataclass(frozen=True)
class Last(Reducer):
    """Value of the latest event in key order."""

    value: Column | str

    @property
    def zero(self) -> Column:
        return F.lit(None)

    def _aggregate(self, key, when, window=None):
        return _over(F.max(_if(when, F.struct(key.alias("key"), expression(self.value).alias("value")))), window)["value"]

    def combine(self, base, tail):
        return F.coalesce(tail, base)


@dataclass(frozen=True)
class Append(Reducer):
    """Values of all events in key order."""

    value: Column | str
    type: str = "bigint"

    @property
    def zero(self) -> Column:
        return F.array().cast(f"array<{self.type}>")

    def _aggregate(self, key, when, window=None):
        rows = _over(F.collect_list(_if(when, F.struct(key.alias("key"), expression(self.value).cast(self.type).alias("value")))), window)
        return F.transform(F.array_sort(rows), lambda x: x["value"])

    def combine(self, base, tail):
        return F.concat(base, tail)


@dataclass(frozen=True)
class ExprFold(Reducer):
    """An order-sensitive fold: `step(state, value)` from `start`, in key order, as built-in expressions."""

    value: Column | str
    start: Column | str
    step: Callable[[Column, Column], Column]

    @property
    def zero(self) -> Column:
        return expression(self.start)

    def _aggregate(self, key, when, window=None):
        rows = _over(F.collect_list(_if(when, F.struct(key.alias("key"), expression(self.value).alias("value")))), window)
        return F.aggregate(F.array_sort(rows), self.zero, lambda state, x: self.step(state, x["value"]))
