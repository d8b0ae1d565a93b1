"""One entity's timeline, faithful to the order in which commands arrive.

The declarative operators define state by event time alone. This machine adds what depends on arrival: stored
checkpoints that a late event erases, authoritative snapshots that are only checkpoints, a base that pruning moves.
It is plain Python over one entity, run by plans.replay (batch) and streaming.processor (live).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

State = Any
Payload = Any
Key = tuple[int, int]


@dataclass(frozen=True)
class Fold:
    """How states come about: `step` makes the next state of a state and an event's payload, and must not change its input."""

    start: Callable[[int], State]
    step: Callable[[State, Payload], State]
    state_size: Callable[[State], int] = lambda _: 28
    event_size: Callable[[Payload], int] = lambda _: 42


@dataclass(frozen=True)
class Change:
    """A range of time whose states are to be read again."""

    snapshot_id: int
    from_time: int
    to_time: int


@dataclass
class Timeline:
    """Events by (time, id), marks (stored states) by key, and a base state for everything before the first mark."""

    sid: int
    fold: Fold
    base: State
    horizon: int = 0
    interval: int = 100
    clock: int = 0
    order: list[Key] = field(default_factory=list)
    events: dict[Key, Payload] = field(default_factory=dict)
    mark_order: list[Key] = field(default_factory=list)
    marks: dict[Key, State] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.interval < 1:
            raise ValueError("interval must be at least 1")

    def _mark(self, key: Key, state: State) -> int:
        if key not in self.marks:
            insort(self.mark_order, key)
        self.marks[key] = state
        return self.fold.state_size(state)

    def _unmark_from(self, key: Key) -> int:
        """Drop the marks at `key` and after; the bytes that frees, negative."""
        cut = bisect_left(self.mark_order, key)
        stale, self.mark_order = self.mark_order[cut:], self.mark_order[:cut]
        return -sum(self.fold.state_size(self.marks.pop(k)) for k in stale)

    def _roll(self, state: State, at: int) -> int:
        """Fold all events from place `at` on, marking every interval-th; the bytes that adds."""
        added = 0
        for n, key in enumerate(self.order[at:], 1):
            state = self.fold.step(state, self.events[key])
            if n % self.interval == 0:
                added += self._mark(key, state)
        return added

    def event(self, time: int, event_id: int, payload: Payload) -> tuple[int, Change | None]:
        """Take an event in; (bytes, change). A repeat changes nothing, yet still reports a late arrival."""
        key = (time, event_id)
        newest = self.order[-1][0] if self.order else None
        change = Change(self.sid, time, newest) if newest is not None and time < newest else None
        if key in self.events:
            return 0, change
        last = not self.order or self.order[-1] < key
        insort(self.order, key)
        self.events[key] = payload
        size = self.fold.event_size(payload)
        if not last:
            size += self._unmark_from(key)
        anchor = self.mark_order[-1] if self.mark_order else None
        state = self.base if anchor is None else self.marks[anchor]
        at = 0 if anchor is None else bisect_right(self.order, anchor)
        if not last:
            return size + self._roll(state, at), change
        if (len(self.order) - at) % self.interval == 0:  # a newest event marks only itself, from the newest mark, wherever that lies
            for k in self.order[at:]:
                state = self.fold.step(state, self.events[k])
            size += self._mark(key, state)
        return size, change

    def snapshot(self, sid: int, time: int, state: State) -> tuple[int, Change | None]:
        """Take an authoritative state in; one of another entity is ignored."""
        if sid != self.sid:
            return 0, None
        key = (time, sid)
        size = self._unmark_from(key) + self._mark(key, state)
        size += self._roll(state, bisect_right(self.order, key))
        return size, Change(sid, time, self.order[-1][0] if self.order else time)

    def advance(self, delta: int) -> int:
        """Move the clock and prune what lies before the horizon; the bytes that frees, negative or 0."""
        self.clock += delta
        edge = (self.clock - self.horizon, -1)
        cut = bisect_left(self.order, edge)
        gone, self.order = self.order[:cut], self.order[cut:]
        freed = -sum(self.fold.event_size(self.events.pop(k)) for k in gone)
        cut = bisect_left(self.mark_order, edge)
        past, self.mark_order = self.mark_order[:cut], self.mark_order[cut:]
        if past:
            self.base = self.marks[past[-1]]
        return freed - sum(self.fold.state_size(self.marks.pop(k)) for k in past)

    def at(self, time: int) -> State:
        """The state at `time`: the last mark up to (time, sid), and the events after it and before (time, sid)."""
        end = (time, self.sid)
        cut = bisect_right(self.mark_order, end)
        state, at = (self.base, 0) if not cut else (self.marks[self.mark_order[cut - 1]], bisect_right(self.order, self.mark_order[cut - 1]))
        for key in self.order[at : bisect_left(self.order, end)]:
            state = self.fold.step(state, self.events[key])
        return state


def opened(sid: int, fold: Fold, horizon: int = 0, interval: int = 100, snapshot: State | None = None) -> tuple[Timeline, int]:
    """A new timeline and its bytes. A snapshot that comes before any event is the base for all times."""
    base = fold.start(sid) if snapshot is None else snapshot
    return Timeline(sid, fold, base, horizon, interval), fold.state_size(base)
