"""The stream's processor without a stream: a state store in memory that counts the messages sent to it."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from tidefold.plans.replay import apply, signed_sum
from tidefold.streaming import processor
from tidefold.streaming.processor import TimelineProcessor, pack

SCHEMA = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("snapshot_id", pa.int64()), ("time", pa.int64()), ("event_id", pa.int64()), ("value", pa.int64()), ("delta", pa.int64())])


class Store(dict):
    """A map state; also the handle that gives it out."""

    sent = written = 0

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        self.sent += 1
        return key in self

    def getValue(self, key):
        self.sent += 1
        return self[key]

    def updateValue(self, key, value):
        self.sent += 1
        self.written += len(value[0])
        self[key] = value

    def removeKey(self, key):
        self.sent += 1
        del self[key]


def run(p, log, shards=1):
    """Results of one micro-batch, as the stream would give them."""
    batch = pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in log], SCHEMA)
    everywhere = [op == "advance" and sid is None for _, op, sid, *_ in log]
    batch = batch.append_column("shard", pa.array([None if x else 0 for x in everywhere], pa.int32()))
    blobs = [r["blob"] for b in pack([batch.slice(0, 5), batch.slice(5)], shards) for r in b.to_pylist() if r["shard"] == 0]
    out = pd.concat(p.handleInputRows((0,), iter([pd.DataFrame({"blob": blobs})]), None))
    return sorted(tuple(None if pd.isna(x) else x for x in row) for row in out.itertuples(index=False))


def plain(log, lines, interval, horizon):
    """The same by the machine itself, an advance sent to all known entities."""
    out = []
    for row in sorted(log):
        row = dict(zip(SCHEMA.names, row, strict=True))
        for sid in list(lines) if row["op"] == "advance" and row["snapshot_id"] is None else [row["snapshot_id"]]:
            line, result = apply(lines.get(sid), row | {"snapshot_id": sid}, signed_sum(), horizon, interval)
            if line:
                lines[sid] = line
            out += [result] if result else []
    return sorted(out)


@pytest.mark.parametrize("whole", [1 << 16, 200, 0])
@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_the_machine(monkeypatch, whole, seed):
    monkeypatch.setattr(processor, "_WHOLE", whole)
    rnd = random.Random(seed)
    store, lines, seq = Store(), {}, 0
    p = TimelineProcessor(horizon=rnd.randrange(60), interval=rnd.choice([1, 3, 10]))
    p.init(store)
    for _ in range(40):
        log = []
        for _ in range(rnd.choice([1, 5, 60])):
            seq += 1
            what, sid, time = rnd.choice(["event"] * 12 + ["snapshot", "query", "query", "advance", "all"]), rnd.randrange(1, 6), seq // 4 + rnd.randrange(-20, 20)
            log.append({"event": (seq, what, sid, time, rnd.randrange(99), rnd.choice([-3, 2**53 + 1]), None), "snapshot": (seq, what, sid, time, None, 7, None), "query": (seq, what, sid, time, None, None, None)}.get(what) or (seq, "advance", None if what == "all" else sid, None, None, None, rnd.randrange(9)))
        rnd.shuffle(log)
        assert run(p, log) == plain(log, lines, p.interval, p.horizon)
    assert {k[0] for k in store} == set(lines)


def test_messages_grow_with_entities_not_with_events():
    """Before, each event was a message to the store, and each command a table of its own."""
    store = Store()
    p = TimelineProcessor()
    p.init(store)
    for n in range(2):
        run(p, [(n * 9999 + k, "event", k % 10, k + n * 9999, k, 1, None) for k in range(5000)])
        assert store.sent <= 30 * (n + 1)


def test_small_batches_do_not_write_a_long_timeline_again():
    store = Store()
    p = TimelineProcessor()
    p.init(store)
    run(p, [(k, "event", 1, k, k, 1, None) for k in range(20_000)])
    first = store.written
    for k in range(20_000, 20_100):
        run(p, [(k, "event", 1, k, k, 1, None)])
    assert store.written < 2 * first
    assert run(p, [(1 << 40, "query", 1, 1 << 40, None, None, None)])[0][6] == 20_100


def test_unknown_commands_are_refused():
    with pytest.raises(ValueError):
        run(TimelineProcessor(), [(0, "remove", 1, 1, 1, 1, None)])
