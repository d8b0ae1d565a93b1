"""Declarative operators against the machine and plain Python on random logs; queries against their SQL."""

import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidefold import operators as op
from tidefold.functions.reducers import Append, Count, ExprFold, Last, Max, Min, Sum
from tidefold.facade import Engine
from tidefold.plans.machine import Fold, opened
from tidefold.plans.replay import COMMANDS, replay
from tidefold.queries import QUERIES, SQL
from tidefold.spec import StateSpec

SPEC = StateSpec(reducers={"total": Sum("value"), "n": Count(), "items": Append("value")})
SCHEMA = "snapshot_id bigint, time bigint, event_id bigint, value bigint, arrival_seq bigint"
LIST = Fold(start=lambda _: (), step=lambda s, v: (*s, v))


def random_log(seed, n=120, repeats=True):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((rnd.randrange(1, 5), rnd.randrange(15), 10 + (rnd.randrange(25) if repeats else k), rnd.randrange(-9, 9), k))
    return rows


def machine(rows, interval=3, horizon=0):
    lines, changes = {}, []
    for sid, time, event_id, value, seq in rows:
        if sid not in lines:
            lines[sid], _ = opened(sid, LIST, horizon, interval)
        _, change = lines[sid].event(time, event_id, value)
        if change:
            changes.append((sid, seq, change.from_time, change.to_time))
    return lines, changes


@pytest.mark.parametrize("seed", range(3))
def test_state_at_one_and_many_instants(spark, seed):
    rows = random_log(seed)
    lines, changes = machine(rows)
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clean = op.dedup(log, SPEC)
    for t in (0, 7, 20):
        got = {r.snapshot_id: (r.total, r.n, tuple(r["items"]), r.time, r.found) for r in op.at(clean, SPEC, F.lit(t)).collect()}
        assert got == {s: (sum(x.at(t)), len(x.at(t)), x.at(t), t, True) for s, x in lines.items()}
    asked = spark.createDataFrame([(s, t) for s in lines for t in range(-1, 17)], "snapshot_id bigint, time bigint")
    got = {(r.snapshot_id, r.time): (r.total, tuple(r["items"])) for r in op.at_many(clean, SPEC, asked).collect()}
    assert got == {(s, t): (sum(x.at(t)), x.at(t)) for s, x in lines.items() for t in range(-1, 17)}
    assert sorted(tuple(r) for r in op.reconciliations(log, SPEC).collect()) == sorted(changes)
    marks = op.checkpoints(clean, SPEC, 3)
    assert {(r.snapshot_id, r.time, r.event_id): tuple(r["items"]) for r in marks.collect()} == {(s, *k): v for s, x in lines.items() for k, v in x.marks.items()}
    got = {r.snapshot_id: tuple(r["items"]) for r in op.at_from_checkpoints(clean, marks, SPEC, F.lit(7)).collect()}
    assert got == {s: x.at(7) for s, x in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_pruning(spark, seed):
    rows = random_log(seed, repeats=False)
    lines, _ = machine(rows)
    for x in lines.values():
        x.advance(8)
    clean = spark.createDataFrame(rows, SCHEMA)
    for t in (5, 9, 20):
        got = {r.snapshot_id: tuple(r["items"]) for r in op.prune_at(clean, SPEC, F.lit(8), F.lit(t), 3).collect()}
        assert got == {s: x.at(t) for s, x in lines.items()}
    got = {r.snapshot_id: (r.kept_events, r.kept_checkpoints) for r in op.retained(clean, SPEC, F.lit(8), 3).collect()}
    assert got == {s: (len(x.order), len(x.marks)) for s, x in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_overrides_in_rising_order_equal_the_machine(spark, seed):
    rows = random_log(seed, repeats=False)
    lines, _ = machine(rows)
    snaps = [(s, t, 1000 * t, t, [t]) for s in lines for t in (3, 9)]
    for s, t, *_, items in snaps:
        lines[s].snapshot(s, t, tuple(items))
    log = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(snaps, "snapshot_id bigint, time bigint, total bigint, n bigint, items array<bigint>")
    for t in (2, 3, 5, 9, 20):
        got = {r.snapshot_id: tuple(r["items"]) for r in op.override_at(log, table, SPEC, F.lit(t)).collect()}
        assert got == {s: x.at(t) for s, x in lines.items()}


def test_reducers(spark):
    rows = random_log(9, repeats=False)
    zero = F.lit(0).cast("bigint")
    spec = StateSpec(reducers={"low": Min(F.col("value")), "high": Max(F.col("value")), "last": Last(F.col("value")), "bal": ExprFold(F.col("value"), zero, lambda s, v: F.greatest(s + v, zero))})
    got = {r.snapshot_id: (r.low, r.high, r["last"], r.bal) for r in op.at(spark.createDataFrame(rows, SCHEMA), spec, F.lit(99)).collect()}
    for s in {r[0] for r in rows}:
        v = [r[3] for r in sorted(rows, key=lambda r: r[1:3]) if r[0] == s]
        bal = 0
        for x in v:
            bal = max(bal + x, 0)
        assert got[s] == (min(v), max(v), v[-1], bal)


def test_not_found_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(5,)], "snapshot_id bigint")
    assert op.at(empty, SPEC, F.lit(1)).collect() == []
    row = op.at(empty, SPEC, F.lit(1), ids=ids).first()
    assert (row.total, row.n, row["items"], row.found) == (0, 0, [], False)
    assert op.reconciliations(empty, SPEC).collect() == [] and op.timeline(empty, SPEC).collect() == []


def test_spec_is_checked():
    with pytest.raises(ValueError):
        StateSpec(sid="a", time="a")
    with pytest.raises(ValueError):
        StateSpec(reducers={"time": Count()})


def test_time_bound_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(random_log(1), SCHEMA).write.parquet(str(tmp_path / "e"))
    plan = op.at(spark.read.parquet(str(tmp_path / "e")), SPEC, F.lit(7), started=True)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(time,7)" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(2))
def test_command_log_equals_the_engine(spark, seed):
    rnd = random.Random(seed)
    log, want = [], []
    with Engine(interval=3, horizon=4) as e:
        for k in range(120):
            sid, t = rnd.randrange(1, 4), rnd.randrange(12)
            what = rnd.choice(["event"] * 6 + ["snapshot", "advance", "query", "query"])
            if what == "event":
                event_id, v = rnd.randrange(9), rnd.randrange(9)
                log.append((k, what, sid, t, event_id, v, None))
                e.apply_event(sid, t, event_id, v)
            elif what == "snapshot":
                log.append((k, what, sid, t, None, 100, None))
                e.apply_snapshot(sid, t, 100)
            elif what == "advance":
                log.append((k, what, None, None, None, None, 2))
                e.advance(2)
            else:
                log.append((k, what, sid, t, None, None, None))
                want.append((k, e.at(t, sid)[0] if sid in e._lines else None))
    got = replay(spark.createDataFrame(log, COMMANDS).repartition(3), horizon=4, interval=3).where("kind = 'query'")
    assert sorted((r.seq, r.state) for r in got.collect()) == want


def test_engine_log_replays_on_spark(spark):
    with Engine(spark) as e:
        e.apply_event((1, 2), 3, 3, 4)
        e.apply_snapshot(1, 5, 50)
        e.advance(1)
        assert {r.snapshot_id: r.state for r in e.replayed([(9, 1), (9, 2), (9, 3)]).collect()} == {1: 50, 2: 4, 3: None}


def test_admission_stops_at_the_budget(spark):
    rows = [(1, k, k + 10, 1, k) for k in range(6)]
    got = op.admit(spark.createDataFrame(rows, SCHEMA), SPEC, 28 + 42 * 3 + 1, 42, 28).orderBy("arrival_seq").collect()
    assert [r.admitted for r in got] == [True, True, True, False, False, False]
    assert [r.usage for r in got][:3] == [0, 70, 112]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not glob.glob(f"{DATA}/orders.parquet"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    with duckdb.connect() as c:
        for t in ("orders", "events", "lineitem", "customer", "conversations"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).values.tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("prices", [(10.0, 90.0), (90.0, 10.0)])
def test_of_snapshots_at_one_time_the_first_wins(spark, tmp_path, prices):
    with duckdb.connect() as c:
        c.execute(f"CREATE TABLE orders AS SELECT * FROM (VALUES (5::BIGINT, 1::BIGINT, {prices[0]}::DOUBLE, TIMESTAMP '1996-02-02'), (7, 1, 3.0, '1996-03-03'), (10, 1, {prices[1]}, '1996-02-02')) AS t(o_orderkey, o_custkey, o_totalprice, o_orderdate)")
        c.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        want = c.execute(SQL["override_state_at"]).df()
    got = QUERIES["override_state_at"](spark, str(tmp_path)).toPandas()
    assert got[["sid", "total", "n"]].values.tolist() == want[["sid", "total", "n"]].values.tolist()


BIG = 2**53


def big_log():
    """Ids and values that floating point can't tell apart, beside nulls."""
    rows = [(0, "event", 1, 10, BIG, 5, None), (1, "event", 1, 10, BIG + 1, 7, None), (2, "query", 1, 11, None, None, None), (3, "event", 2, 10, 1, BIG + 1, None)]
    return [*rows, (4, "advance", None, None, None, None, 1), (5, "query", 2, 11, None, None, None), (6, "event", 2, BIG + 1, 3, 1, None), (7, "query", 2, BIG + 2, None, None, None), (8, "event", 2, BIG - 1, 4, 1, None)]


def check_big(rows):
    assert sorted((r.seq, r.state) for r in rows if r.kind == "query") == [(2, 12), (5, BIG + 1), (7, BIG + 2)]
    assert [(r.from_time, r.to_time) for r in rows if r.kind == "change"] == [(BIG - 1, BIG + 1)]


def test_large_numbers_are_exact_in_batch(spark):
    check_big(replay(spark.createDataFrame(big_log(), COMMANDS).repartition(3), horizon=BIG).collect())


def test_stream_equals_batch(spark):
    from tidefold.queries import _streamed

    check_big(_streamed(spark, spark.createDataFrame(big_log(), COMMANDS), horizon=BIG).collect())
    rnd = random.Random(4)
    log = []
    for k in range(150):
        log.append((k, "event", 1 + k % 2, k, k + 10, 1, None))
    log += [(200, "advance", None, None, None, None, 120), (201, "event", 3, 5, 5, 8, None), (202, "snapshot", 1, 130, None, 1000, None), (203, "advance", None, None, None, None, 3)]
    for k in range(300, 360):
        log.append((k, *rnd.choice([("event", rnd.randrange(1, 5), rnd.randrange(200), rnd.randrange(400), 2, None), ("query", rnd.randrange(1, 6), rnd.randrange(250), None, None, None), ("advance", None, None, None, None, 1)])))
    commands = spark.createDataFrame(log, COMMANDS)
    want = sorted(map(str, replay(commands, interval=7).collect()))
    assert sorted(map(str, _streamed(spark, commands, interval=7).collect())) == want and len(want) > 20
