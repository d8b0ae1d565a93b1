"""The arrival-faithful machine: asserted scenarios, and random logs against the plain fold."""

import random

import pytest

from tidefold.facade import ClosedError, Engine, MemoryFullError, NotFoundError
from tidefold.plans.machine import Change, Fold, Timeline, opened

LIST = Fold(start=lambda _: (0, ()), step=lambda s, v: (s[0] + v, (*s[1], v)), state_size=lambda s: 28 + 2 * len(s[1]), event_size=lambda _: 42)


def line(interval=100, horizon=0, sid=1):
    return opened(sid, LIST, horizon, interval)[0]


class Model:
    """The machine's rules in the plainest form: sorted lists, everything folded anew."""

    def __init__(self, sid, interval, horizon):
        self.sid, self.interval, self.horizon, self.clock = sid, interval, horizon, 0
        self.base, self.events, self.marks = (0, ()), {}, {}

    def fold(self, state, keys):
        for k in keys:
            state = (state[0] + self.events[k], (*state[1], self.events[k]))
        return state

    def event(self, time, event_id, value):
        key, old = (time, event_id), sorted(self.events)
        late = bool(old) and time < old[-1][0]
        if key not in self.events:
            self.events[key] = value
            if old and key < old[-1]:
                self.marks = {k: v for k, v in self.marks.items() if k < key}
                self.rebuild()
            else:
                last = max(self.marks, default=None)
                tail = [k for k in sorted(self.events) if last is None or k > last]
                if len(tail) % self.interval == 0:
                    self.marks[key] = self.fold(self.base if last is None else self.marks[last], tail)
        return (self.sid, time, old[-1][0]) if late else None

    def rebuild(self):
        last = max(self.marks, default=None)
        state = self.base if last is None else self.marks[last]
        for n, k in enumerate([k for k in sorted(self.events) if last is None or k > last], 1):
            state = self.fold(state, [k])
            if n % self.interval == 0:
                self.marks[k] = state

    def snapshot(self, time, state):
        key = (time, self.sid)
        self.marks = {k: v for k, v in self.marks.items() if k < key} | {key: state}
        self.rebuild()
        return self.sid, time, max(self.events)[0] if self.events else time

    def advance(self, delta):
        self.clock += delta
        edge = self.clock - self.horizon
        self.events = {k: v for k, v in self.events.items() if k[0] >= edge}
        past = [k for k in self.marks if k[0] < edge]
        if past:
            self.base = self.marks[max(past)]
        self.marks = {k: v for k, v in self.marks.items() if k[0] >= edge}

    def at(self, time):
        end = (time, self.sid)
        last = max((k for k in self.marks if k <= end), default=None)
        return self.fold(self.base if last is None else self.marks[last], [k for k in sorted(self.events) if k < end and (last is None or k > last)])


@pytest.mark.parametrize("seed", range(8))
def test_random_commands_equal_the_plain_model(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        interval, horizon = rnd.choice([1, 2, 3, 5, 100]), rnd.randrange(12)
        t, m = line(interval, horizon, sid=4), Model(4, interval, horizon)
        for _ in range(rnd.randrange(60)):
            what, time = rnd.random(), rnd.randrange(-5, 25)
            if what < 0.75:
                one, two = t.event(time, e := rnd.randrange(9), v := rnd.randrange(-5, 6))[1], m.event(time, e, v)
            elif what < 0.9:
                state = (rnd.randrange(100, 999), ())
                one, two = t.snapshot(4, time, state)[1], m.snapshot(time, state)
            else:
                freed, one, two = t.advance(d := rnd.randrange(6)), None, m.advance(d)
                assert freed <= 0
            assert (one and (one.snapshot_id, one.from_time, one.to_time)) == two
            assert t.marks == m.marks and t.order == sorted(m.events) and t.base == m.base
            assert all(t.at(k) == m.at(k) for k in range(-6, 27, 3))


def test_snapshot_of_another_entity_is_ignored():
    t = line()
    t.event(3, 3, 9)
    assert t.snapshot(8, 2, (70, ())) == (0, None) and not t.marks and t.at(4)[0] == 9


def test_changes():
    t = line()
    assert t.event(1, 1, 1)[1] is None and t.event(2, 2, 1)[1] is None
    t = line()
    t.event(10, 10, 1)
    assert t.event(5, 5, 1)[1] == Change(1, 5, 10)
    assert t.snapshot(1, 5, (0, ()))[1] == Change(1, 5, 10)
    assert t.event(5, 5, 1) == (0, Change(1, 5, 10))  # a repeat is still late
    assert t.event(10, 3, 1)[1] is None  # equal time, lower id: replayed, not reported


def test_change_may_run_backwards():
    t = line()
    t.event(5, 5, 1)
    assert t.snapshot(1, 20, (0, ()))[1] == Change(1, 20, 5)


def test_late_event_erases_snapshot():
    t = line()
    t.event(1, 1, 10)
    t.event(5, 5, 20)
    t.snapshot(1, 3, (100, ()))
    assert t.at(11)[0] == 120
    t.event(2, 2, 1)
    assert t.at(11)[0] == 31


def test_earlier_snapshot_erases_later_one():
    t = line()
    t.event(1, 1, 1)
    t.snapshot(1, 20, (500, ()))
    t.snapshot(1, 10, (50, ()))
    assert t.at(21)[0] == 50


def test_newest_event_before_a_snapshot_marks_the_snapshot():
    t = line()
    t.event(10, 10, 1)
    t.snapshot(1, 20, (500, ()))
    t.event(15, 15, 7)
    assert [t.at(k)[0] for k in (15, 16, 21)] == [1, 500, 500]


def test_own_id_at_the_instant_shows_if_marked():
    for interval, want in ((1, 1), (100, 0)):
        t = line(interval, sid=7)
        t.event(5, 7, 1)
        assert t.at(5)[0] == want


def test_pruning_loses_events_after_the_last_checkpoint():
    t = line()
    for k in range(150):
        t.event(k, k + 10, 1)
    assert t.at(150)[0] == 150
    t.advance(120)
    assert t.at(150)[0] == 130 and t.base[0] == 100 and len(t.order) == 30


def test_pruned_event_applies_again():
    t = line()
    t.event(5, 5, 1)
    t.advance(6)
    t.event(5, 5, 1)
    assert t.at(99)[0] == 1


def test_interval_must_be_positive():
    with pytest.raises(ValueError):
        Timeline(1, LIST, 0, interval=0)


@pytest.mark.parametrize("interval", [1, 2, 3, 7])
def test_random_logs_equal_the_plain_fold(interval):
    rnd = random.Random(interval)
    for _ in range(100):
        log = [(rnd.randrange(12), rnd.randrange(2, 30), rnd.randrange(9)) for _ in range(rnd.randrange(1, 40))]
        t, first = line(interval), {}
        for time, event_id, v in log:
            t.event(time, event_id, v)
            first.setdefault((time, event_id), v)
        keys = sorted(first)
        assert sorted(t.marks) == keys[interval - 1 :: interval]
        for at in range(14):
            assert t.at(at)[1] == tuple(first[k] for k in keys if k < (at, 1))


def test_engine_queries():
    with Engine() as e:
        e.apply_event(1, 0, 0, 5)
        assert e.at(1, 1)[0] == 5 and e.at(0, 1)[0] == 5  # id below the entity's: in at its own time
        e.apply_event(2, 5, 5, 42)
        assert e.at(5, 2)[0] == 0 and e.at(6, 2)[0] == 42
        with pytest.raises(NotFoundError):
            e.at(0, 999)
        with pytest.raises(NotFoundError):
            e.query_at(0, 999).result()


def test_engine_reports_changes_to_every_reader():
    with Engine() as e:
        e.apply_event(1, 100, 100, 1)
        one, two = e.at(101, 1)[1], e.at(101, 1)[1]
        for k in (50, 30, 10):
            e.apply_event(1, k, k, 1)
        want = [Change(1, k, 100) for k in (50, 30, 10)]
        assert one.drain() == want and two.drain() == want and one.drain() == []


def test_engine_futures_are_first_in_first_out():
    with Engine() as e:
        sent = [e.send_event(1, k, k, 10) for k in range(5)]
        asked = e.query_at(5, 1)
        assert asked.result()[0] == 50 and all(f.done() for f in sent)
        e.send_snapshot(1, 0, 99).result()
        assert e.at(9, 1)[0] == 99 + 40


def test_engine_memory():
    with Engine(memory_budget=100) as e:
        e.apply_event(1, 0, 0, 0)
        with pytest.raises(MemoryFullError):
            e.apply_event(1, 1, 1, 1)
    with Engine(memory_budget=500) as e:
        last = 0
        with pytest.raises(MemoryFullError):
            for last in range(100):
                e.apply_event(1, last, last, 1)
        e.advance(last + 100)
        e.apply_event(1, last + 1, last + 1, 1)
    with Engine(memory_budget=100, fold=LIST) as e, pytest.raises(MemoryFullError):
        e.apply_snapshot(1, 0, (0, tuple(range(1000))))


def test_engine_advance_drops_state():
    with Engine() as e:
        e.apply_event(1, 1, 1, 10)
        e.apply_event(2, 1, 2, 20)
        e.send_advance(100).result()
        e.apply_event(1, 200, 200, 5)
        assert e.at(201, 1)[0] == 5


def test_engine_fans_out_and_closes():
    e = Engine()
    e.apply_event((1, 2), 3, 3, 4)
    assert e.at(9, 1)[0] == e.at(9, 2)[0] == 4
    e.close()
    with pytest.raises(ClosedError):
        e.send_advance(1)
    with pytest.raises(ValueError):
        Engine(memory_budget=0)


def test_ordered_values():
    with Engine(fold=LIST) as e:
        e.apply_event(1, 5, 100, 50)
        e.apply_event(1, 10, 101, 100)
        state, reader = e.at(11, 1)
        assert state[1] == (50, 100)
        e.apply_event(1, 7, 102, 70)
        assert reader.drain() == [Change(1, 7, 10)]
        assert [e.at(k, 1)[0][1] for k in (6, 8, 11)] == [(50,), (50, 70), (50, 70, 100)]
