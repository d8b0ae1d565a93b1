"""The library's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import operators as op
from tidefold.functions.reducers import Append, Count, ExprFold, Last, Max, Sum
from tidefold.plans.machine import Fold
from tidefold.plans.replay import replay
from tidefold.sources import table
from tidefold.spec import StateSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
ORDERS = StateSpec("o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", {"total": Sum(CENTS), "n": Count()})
_ORDERS = "SELECT o_custkey AS sid, o_orderdate AS tm, o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders"
AT = "timestamp_ntz'1998-01-01 00:00:00'"
_AT = "timestamp '1998-01-01 00:00:00'"
_BEFORE = "(tm < {t} OR (tm = {t} AND id < sid))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")


@_query(f"SELECT sid AS o_custkey, {_AT} AS o_orderdate, CAST(coalesce(sum(v) FILTER ({_BEFORE.format(t=_AT)}), 0) AS BIGINT) AS total, CAST(count(*) FILTER ({_BEFORE.format(t=_AT)}) AS BIGINT) AS n, true AS found FROM ({_ORDERS}) GROUP BY sid")
def state_at(spark, sf_dir):
    return op.at(_orders(spark, sf_dir), ORDERS, F.expr(AT))


@_query(f"SELECT sid AS o_custkey, {_AT} AS o_orderdate, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, true AS found FROM ({_ORDERS}) WHERE tm < {_AT} GROUP BY sid")
def state_at_strict_time(spark, sf_dir):
    return op.at(_orders(spark, sf_dir), ORDERS, F.expr(AT), strict=True, started=True)


EVENT_CENTS = "CAST(round(value * 100) AS BIGINT)"
SIGNED = f"CASE WHEN event_type IN ('error', 'view') THEN -{EVENT_CENTS} ELSE {EVENT_CENTS} END"
_EVENTS = "SELECT user_id AS sid, ts AS tm, event_id AS id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events"


def _events_spec(**reducers) -> StateSpec:
    return StateSpec("user_id", "ts", "event_id", "event_id", reducers)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


END = "timestamp_ntz'2100-01-01 00:00:00'"


@_query(f"SELECT sid AS user_id, timestamp '2100-01-01 00:00:00' AS ts, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, true AS found FROM ({_EVENTS}) WHERE sid = 7 GROUP BY sid")
def state_at_single_entity(spark, sf_dir):
    return op.at(_events(spark, sf_dir).where("user_id = 7"), _events_spec(total=Sum(EVENT_CENTS), n=Count()), F.expr(END), started=True)


_GRID = "SELECT unnest([timestamp '1993-01-01', timestamp '1995-06-17', timestamp '1998-01-01', timestamp '2001-01-01']) AS t"


@_query(
    f"WITH o AS ({_ORDERS}), q AS (SELECT sid, t FROM (SELECT DISTINCT sid FROM o), ({_GRID})) SELECT q.sid AS o_custkey, q.t AS o_orderdate, CAST(coalesce(sum(v) FILTER (tm < t OR (tm = t AND id < o.sid)), 0) AS BIGINT) AS total, CAST(count(*) FILTER (tm < t OR (tm = t AND id < o.sid)) AS BIGINT) AS n FROM q JOIN o ON o.sid = q.sid GROUP BY q.sid, q.t"
)
def state_at_many(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    instants = F.array(*[F.expr(f"timestamp_ntz'{t} 00:00:00'") for t in ("1993-01-01", "1995-06-17", "1998-01-01", "2001-01-01")])
    return op.at_many(orders, ORDERS, orders.select("o_custkey").distinct().select("o_custkey", F.explode(instants).alias("o_orderdate")))


@_query(
    f"WITH o AS ({_ORDERS}), ids AS (SELECT c_custkey AS sid FROM customer UNION SELECT c_custkey + 1000000 FROM customer) SELECT ids.sid AS o_custkey, {_AT} AS o_orderdate, CAST(coalesce(sum(v) FILTER (tm < {_AT} OR (tm = {_AT} AND id < o.sid)), 0) AS BIGINT) AS total, CAST(count(v) FILTER (tm < {_AT} OR (tm = {_AT} AND id < o.sid)) AS BIGINT) AS n, count(o.sid) > 0 AS found FROM ids LEFT JOIN o ON o.sid = ids.sid GROUP BY ids.sid"
)
def state_not_found(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1000000)).alias("o_custkey"))
    return op.at(_orders(spark, sf_dir), ORDERS, F.expr(AT), ids=ids)


@_query(
    f"SELECT sid AS o_custkey, tm AS o_orderdate, id AS o_orderkey, CAST(row_number() OVER w AS BIGINT) AS event_number, CAST(sum(v) OVER w AS BIGINT) AS total FROM ({_ORDERS}) WINDOW w AS (PARTITION BY sid ORDER BY tm, id ROWS UNBOUNDED PRECEDING)"
)
def timeline_running_sum(spark, sf_dir):
    return op.timeline(_orders(spark, sf_dir), StateSpec("o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", {"total": Sum(CENTS)}))


@_query(f"SELECT sid AS o_custkey, array_to_string(list(v ORDER BY tm, id), ',') AS joined, CAST(count(*) AS BIGINT) AS n FROM ({_ORDERS}) WHERE {_BEFORE.format(t=_AT)} GROUP BY sid")
def ordered_values(spark, sf_dir):
    spec = StateSpec("o_custkey", "o_orderdate", "o_orderkey", "o_orderkey", {"items": Append(CENTS)})
    return op.at(_orders(spark, sf_dir), spec, F.expr(AT), started=True).select("o_custkey", F.array_join("items", ",").alias("joined"), F.size("items").cast("bigint").alias("n"))


@_query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, array_to_string(list(role ORDER BY turn, length(text), text), '>') AS roles FROM conversations GROUP BY conv_id")
def conversation_fold(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").withColumn("place", F.struct(F.length("text").alias("n"), "text"))
    spec = StateSpec("conv_id", "turn", "place", "turn", {"roles": Append("role", "string"), "n": Count()})
    folded = op.at(talks, spec, F.lit(2**62), started=True, strict=True)
    return folded.select("conv_id", "n", F.array_join("roles", ">").alias("roles"))


@_query(f"SELECT sid AS user_id, CAST(sum(CASE WHEN event_type IN ('error', 'view') THEN -v ELSE v END) AS BIGINT) AS total FROM ({_EVENTS}) GROUP BY sid")
def signed_sum_fold(spark, sf_dir):
    return op.at(_events(spark, sf_dir), _events_spec(total=Sum(SIGNED)), F.expr(END)).select("user_id", "total")


_LINES = "SELECT l_suppkey AS sid, l_shipdate AS tm, l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS v, l_returnflag AS flag, l_partkey FROM lineitem"
#: Lineitem has a few rows of one key; the part tells them apart.
LINES = StateSpec("l_suppkey", "l_shipdate", "id", "arrival", {"total": Sum("v")})


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select("l_suppkey", "l_shipdate", number.alias("id"), F.struct("l_partkey", F.col("l_quantity")).alias("arrival"), F.col("l_quantity").cast("bigint").alias("v"), "l_returnflag")


@_query(f"SELECT sid AS l_suppkey, CAST(coalesce(sum(v) FILTER (flag = 'R'), 0) AS BIGINT) AS total FROM ({_LINES}) GROUP BY sid")
def filtered_sum_fold(spark, sf_dir):
    spec = StateSpec("l_suppkey", "l_shipdate", "id", "arrival", {"total": Sum("CASE WHEN l_returnflag = 'R' THEN v END")})
    return op.at(_lines(spark, sf_dir), spec, F.expr(END)).select("l_suppkey", "total")


@_query(f"SELECT sid AS user_id, max_by(event_type, struct_pack(a := tm, b := id)) AS last_type, max(v) AS highest FROM ({_EVENTS}) GROUP BY sid")
def last_value_fold(spark, sf_dir):
    return op.at(_events(spark, sf_dir), _events_spec(last_type=Last("event_type"), highest=Max(EVENT_CENTS)), F.expr(END)).select("user_id", "last_type", "highest")


@_query(
    "SELECT sid AS user_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(x ORDER BY tm, id)), lambda a, b: greatest(a + b, 0)) AS BIGINT) AS balance "
    f"FROM (SELECT sid, tm, id, CASE WHEN event_type IN ('error', 'view') THEN -v ELSE v END AS x FROM ({_EVENTS})) GROUP BY sid"
)
def nonlinear_fold(spark, sf_dir):
    fold = ExprFold(SIGNED, "0L", lambda state, x: F.greatest(state + x, F.lit(0).cast("bigint")))
    return op.at(_events(spark, sf_dir), _events_spec(balance=fold), F.expr(END)).select("user_id", "balance")


#: The orders, every third delivered again with another value, after all others.
_TWICE = f"SELECT sid, tm, id, v, id AS arrival FROM ({_ORDERS}) UNION ALL SELECT sid, tm, id, v + 1, id + 100000000 FROM ({_ORDERS}) WHERE id % 3 = 0"
TWICE = StateSpec("sid", "tm", "id", "arrival", {"total": Sum("v"), "n": Count()})


def _twice(spark, sf_dir):
    once = _orders(spark, sf_dir).select(F.col("o_custkey").alias("sid"), F.col("o_orderdate").alias("tm"), F.col("o_orderkey").alias("id"), F.expr(CENTS).alias("v"), F.col("o_orderkey").alias("arrival"))
    return once.unionAll(once.where("id % 3 = 0").select("sid", "tm", "id", F.col("v") + 1, F.col("arrival") + 100000000))


@_query(f"SELECT sid, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sid, tm, id ORDER BY arrival) AS k FROM ({_TWICE})) WHERE k = 1 GROUP BY sid")
def dedup_first_arrival(spark, sf_dir):
    return op.at(op.dedup(_twice(spark, sf_dir), TWICE), TWICE, F.expr(END)).select("sid", "total", "n")


@_query(f"SELECT sid, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT sid, tm, id, v FROM ({_ORDERS}) UNION ALL SELECT sid, tm + INTERVAL 1 DAY, id, v FROM ({_ORDERS}) WHERE id % 2 = 0) GROUP BY sid")
def dup_ids_diff_times(spark, sf_dir):
    once = _orders(spark, sf_dir).select(F.col("o_custkey").alias("sid"), F.col("o_orderdate").alias("tm"), F.col("o_orderkey").alias("id"), F.expr(CENTS).alias("v"), F.col("o_orderkey").alias("arrival"))
    moved = once.where("id % 2 = 0").withColumn("tm", F.expr("tm + INTERVAL 1 DAY"))
    return op.at(op.dedup(once.unionByName(moved), TWICE), TWICE, F.expr(END)).select("sid", "total", "n")


_FIRST = f"SELECT sid, tm, id, v FROM (SELECT *, row_number() OVER (PARTITION BY sid, tm, id ORDER BY l_partkey, v) AS k FROM ({_LINES})) WHERE k = 1"
_RUN = f"SELECT *, CAST(row_number() OVER w AS BIGINT) AS n, CAST(sum(v) OVER w AS BIGINT) AS total FROM ({_FIRST}) WINDOW w AS (PARTITION BY sid ORDER BY tm, id ROWS UNBOUNDED PRECEDING)"


@_query(f"SELECT sid AS l_suppkey, tm AS l_shipdate, id, n AS event_number, total FROM ({_RUN}) WHERE n % 100 = 0")
def checkpoints_every_100(spark, sf_dir):
    return op.checkpoints(op.dedup(_lines(spark, sf_dir), LINES), LINES)


MID = "timestamp_ntz'1995-06-17 00:00:00'"
_MID = "timestamp '1995-06-17 00:00:00'"


@_query(f"SELECT sid AS l_suppkey, {_MID} AS l_shipdate, CAST(coalesce(sum(v) FILTER ({_BEFORE.format(t=_MID)}), 0) AS BIGINT) AS total FROM ({_FIRST}) GROUP BY sid")
def state_from_checkpoint(spark, sf_dir):
    lines = op.dedup(_lines(spark, sf_dir), LINES)
    return op.at_from_checkpoints(lines, op.checkpoints(lines, LINES), LINES, F.expr(MID))


_LATE = "SELECT sid, arrival, tm AS from_time, latest AS to_time FROM (SELECT *, max(tm) OVER (PARTITION BY sid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ({log})) WHERE tm < latest"


@_query(_LATE.format(log=f"SELECT *, id AS arrival FROM ({_ORDERS})"))
def late_event_reconciliation(spark, sf_dir):
    once = _twice(spark, sf_dir).where("arrival = id")
    return op.reconciliations(once, TWICE).select("sid", "arrival", "from_time", "to_time")


@_query(_LATE.format(log=_TWICE))
def late_with_duplicates(spark, sf_dir):
    return op.reconciliations(_twice(spark, sf_dir), TWICE).select("sid", "arrival", "from_time", "to_time")


#: One authoritative snapshot for every fifth order, a minute before it, arriving in between.
_SNAPS = f"SELECT sid, tm - INTERVAL 1 MINUTE AS tm, id * 2 + 1 AS arrival, v * 10 AS total, CAST(7 AS BIGINT) AS n FROM ({_ORDERS}) WHERE id % 5 = 0"


def _snapshots(spark, sf_dir):
    once = _twice(spark, sf_dir).where("arrival = id AND id % 5 = 0")
    return once.select("sid", F.expr("tm - INTERVAL 1 MINUTE").alias("tm"), (F.col("id") * 2 + 1).alias("arrival"), (F.col("v") * 10).alias("total"), F.lit(7).cast("bigint").alias("n"))


@_query(
    f"WITH log AS (SELECT sid, id * 2 AS arrival, tm, false AS s FROM ({_ORDERS}) UNION ALL SELECT sid, arrival, tm, true FROM ({_SNAPS})), w AS (SELECT *, max(CASE WHEN NOT s THEN tm END) OVER w AS latest, count(*) OVER w AS b FROM log WINDOW w AS (PARTITION BY sid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT sid, arrival, tm AS from_time, coalesce(latest, tm) AS to_time FROM w WHERE s AND b > 0"
)
def snapshot_reconciliation(spark, sf_dir):
    log = _twice(spark, sf_dir).where("arrival = id").withColumn("arrival", F.col("id") * 2)
    return op.snapshot_reconciliations(log, _snapshots(spark, sf_dir), TWICE)


@_query(f"SELECT sid, arrival, from_time, to_time FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY arrival) AS k FROM ({_LATE.format(log=f'SELECT *, id AS arrival FROM ({_ORDERS})')})) WHERE k <= 5")
def reconciliation_capacity(spark, sf_dir):
    changes = op.reconciliations(_twice(spark, sf_dir).where("arrival = id"), TWICE)
    return op.capacity(changes, TWICE, 5).select("sid", "arrival", "from_time", "to_time")


@_query(
    f"WITH o AS ({_ORDERS}), best AS (SELECT sid, max(tm) AS s, max_by(total, tm) AS total, max_by(n, tm) AS n FROM ({_SNAPS}) WHERE tm <= {_AT} GROUP BY sid), ids AS (SELECT sid FROM o UNION SELECT sid FROM ({_SNAPS})) "
    f"SELECT ids.sid, {_AT} AS tm, CAST(coalesce(any_value(best.total), 0) + coalesce(sum(v) FILTER ((s IS NULL OR o.tm > s OR (o.tm = s AND id > o.sid)) AND (o.tm < {_AT} OR (o.tm = {_AT} AND id < o.sid))), 0) AS BIGINT) AS total, "
    f"CAST(coalesce(any_value(best.n), 0) + count(v) FILTER ((s IS NULL OR o.tm > s OR (o.tm = s AND id > o.sid)) AND (o.tm < {_AT} OR (o.tm = {_AT} AND id < o.sid))) AS BIGINT) AS n "
    "FROM ids LEFT JOIN o ON o.sid = ids.sid LEFT JOIN best ON best.sid = ids.sid GROUP BY ids.sid"
)
def override_state_at(spark, sf_dir):
    # of snapshots at one time the first to arrive wins, as in the SQL, which keeps the first row of the greatest time
    best = _snapshots(spark, sf_dir).groupBy("sid", "tm").agg(F.min_by("total", "arrival").alias("total"), F.min_by("n", "arrival").alias("n"))
    return op.override_at(_twice(spark, sf_dir).where("arrival = id"), best, TWICE, F.expr(AT))


DROP = "timestamp_ntz'1995-01-01 00:00:00'"
_DROP = "timestamp '1995-01-01 00:00:00'"
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY sid ORDER BY tm, id) AS n, count(*) FILTER (tm < {_DROP}) OVER (PARTITION BY sid) AS d FROM ({_FIRST})"


@_query(
    f"WITH r AS (SELECT *, d - d % 100 AS p, (tm < {_MID} OR (tm = {_MID} AND id < sid)) AS b FROM ({_NUMBERED})), m AS (SELECT *, coalesce(bool_or(n > d AND n % 100 = 0 AND (b OR (tm = {_MID} AND id = sid))) OVER (PARTITION BY sid), false) AS whole FROM r) "
    f"SELECT sid AS l_suppkey, {_MID} AS l_shipdate, CAST(coalesce(sum(v) FILTER (CASE WHEN whole THEN b ELSE n <= p OR (n > d AND b) END), 0) AS BIGINT) AS total FROM m GROUP BY sid"
)
def prune_then_query(spark, sf_dir):
    return op.prune_at(op.dedup(_lines(spark, sf_dir), LINES), LINES, F.expr(DROP), F.expr(MID))


@_query(f"SELECT sid AS l_suppkey, CAST(count(*) FILTER (n > d) AS BIGINT) AS kept_events, CAST(max(d) AS BIGINT) AS dropped_events, CAST(count(*) FILTER (n > d AND n % 100 = 0) AS BIGINT) AS kept_checkpoints, CAST(max(d - d % 100) AS BIGINT) AS based_on FROM ({_NUMBERED}) GROUP BY sid")
def prune_retained(spark, sf_dir):
    return op.retained(op.dedup(_lines(spark, sf_dir), LINES), LINES, F.expr(DROP))


@_query(
    "SELECT lane, sid AS snapshot_id, CAST(sum(q) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'supplier' AS lane, l_suppkey AS sid, CAST(l_quantity AS BIGINT) AS q FROM lineitem UNION ALL SELECT 'part', l_partkey + 1099511627776, CAST(l_quantity AS BIGINT) FROM lineitem UNION ALL SELECT 'order', l_orderkey + 2199023255552, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_returnflag = 'R') GROUP BY lane, sid"
)
def fanout_lanes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_returnflag")
    each = op.fan_out(lines, {"supplier": F.col("l_suppkey"), "part": F.col("l_partkey"), "order": F.col("l_orderkey")}, when={"order": F.col("l_returnflag") == "R"})
    return each.groupBy("lane", "snapshot_id").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count("*").alias("n"))


@_query("SELECT CAST(o_custkey % 8 AS BIGINT) AS partition, CAST(count(DISTINCT o_custkey) AS BIGINT) AS entities, CAST(count(*) AS BIGINT) AS events FROM orders GROUP BY o_custkey % 8")
def hash_partition_counts(spark, sf_dir):
    # with the identity for a hash, SQL can tell which partition each entity is in
    return op.partition_counts(_orders(spark, sf_dir), ORDERS, 8, by=F.col("o_custkey"))


@_query(
    f"SELECT e.sid AS l_suppkey, CAST(42 * n AS BIGINT) AS event_bytes, CAST(28 * (n // 100) AS BIGINT) AS checkpoint_bytes, CAST(28 AS BIGINT) AS base_bytes, CAST(42 * n + 28 * (n // 100) + 28 AS BIGINT) AS total_bytes FROM (SELECT sid, count(*) AS n FROM ({_FIRST}) GROUP BY sid) e"
)
def memory_usage(spark, sf_dir):
    return op.memory_usage(op.dedup(_lines(spark, sf_dir), LINES), LINES, F.lit(42), F.lit(28), 28)


@_query(
    f"SELECT sid AS o_custkey, id AS o_orderkey, usage, usage + 42 < 300000 AS admitted FROM (SELECT sid, id, CAST(coalesce(sum(42 + CASE WHEN k = 1 THEN 28 ELSE 0 END + CASE WHEN k % 100 = 0 THEN 28 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS usage FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY id) AS k FROM ({_ORDERS})))"
)
def memory_admission(spark, sf_dir):
    return op.admit(_orders(spark, sf_dir), ORDERS, 300000, 42, 28).select("o_custkey", "o_orderkey", "usage", "admitted")


#: Every event twice, the second time with another value, dealt out in an order of arrival that has nothing to do with time.
_SHUFFLED = f"SELECT sid, tm, id, v + c AS v, (id * 7919 + c * 104729) % 1000003 AS arrival, c FROM ({_EVENTS}), (SELECT unnest([0, 1]) AS c)"


@_query(
    f"SELECT sid AS user_id, array_to_string(list(v ORDER BY tm, id), ',') AS joined FROM (SELECT *, row_number() OVER (PARTITION BY sid, tm, id ORDER BY arrival, c) AS k FROM ({_SHUFFLED})) WHERE k = 1 GROUP BY sid"
)
def out_of_order_determinism(spark, sf_dir):
    log = _events(spark, sf_dir).withColumn("v", F.expr(EVENT_CENTS)).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    log = log.withColumn("arrival", F.struct(((F.col("event_id") * 7919 + F.col("c") * 104729) % 1000003).alias("a"), "c"))
    spec = StateSpec("user_id", "ts", "event_id", "arrival", {"items": Append(F.col("v") + F.col("c"))})
    return op.at(op.dedup(log, spec), spec, F.expr(END)).select("user_id", F.array_join("items", ",").alias("joined"))


def _commands(log: DataFrame, sid: str, time: str, event_id: str, value, order) -> DataFrame:
    """An event log and, after it, one query an entity, as commands; times in microseconds."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    events = log.select(order.alias("seq"), F.lit("event").alias("op"), F.col(sid).alias("snapshot_id"), micros.alias("time"), F.col(event_id).alias("event_id"), value.alias("value"), F.lit(None).cast("bigint").alias("delta"))
    asked = log.select(F.col(sid).alias("snapshot_id")).distinct().select(
        (F.lit(1 << 50) + F.col("snapshot_id")).alias("seq"), F.lit("query").alias("op"), "snapshot_id", F.lit(1 << 60).alias("time"), F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("bigint").alias("delta")
    )
    return events.unionByName(asked)


@_query(f"SELECT sid AS snapshot_id, CAST(sum(v) AS BIGINT) AS state, true AS found FROM ({_ORDERS}) GROUP BY sid")
def compat_command_log(spark, sf_dir):
    log = _commands(_orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", F.expr(CENTS), F.col("o_orderkey"))
    return replay(log).where("kind = 'query'").select("snapshot_id", "state", "found")


#: Two authoritative snapshots an entity, after all its events, the later one in time first: the earlier one erases it.
_TWO = f"SELECT sid, quantile_disc(tm, 0.25) AS early, quantile_disc(tm, 0.75) AS late FROM ({_ORDERS}) GROUP BY sid"


def _log(df: DataFrame, seq, what: str, time=None, value=None, delta=None, sid="o_custkey") -> DataFrame:
    """One command for every row."""
    null = F.lit(None).cast("bigint")
    pick = lambda x: null if x is None else x.cast("bigint")
    return df.select(seq.cast("bigint").alias("seq"), F.lit(what).alias("op"), (F.col(sid) if sid else null).alias("snapshot_id"), pick(time).alias("time"), null.alias("event_id"), pick(value).alias("value"), pick(delta).alias("delta"))


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _events_log(orders: DataFrame) -> DataFrame:
    return _commands(orders, "o_custkey", "o_orderdate", "o_orderkey", F.expr(CENTS), F.col("o_orderkey")).where("op = 'event'")


@_query(
    f"SELECT o.sid AS snapshot_id, CAST(any_value(o.sid) * 1000 + coalesce(sum(v) FILTER (tm > early OR (tm = early AND id > o.sid)), 0) AS BIGINT) AS state FROM ({_ORDERS}) o JOIN ({_TWO}) t ON t.sid = o.sid GROUP BY o.sid"
)
def compat_snapshots(spark, sf_dir):
    """A snapshot earlier in time erases a later one that came before; events after it are folded on top."""
    orders = _orders(spark, sf_dir)
    two = orders.groupBy("o_custkey").agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY unix_micros(CAST(o_orderdate AS timestamp)))").alias("early"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY unix_micros(CAST(o_orderdate AS timestamp)))").alias("late"))
    base = F.lit(1 << 40) + F.col("o_custkey") * 4
    log = _events_log(orders).unionByName(_log(two, base, "snapshot", F.col("late"), F.lit(-(10**9)))).unionByName(_log(two, base + 1, "snapshot", F.col("early"), F.col("o_custkey") * 1000))
    return replay(log.unionByName(_log(two, base + 2, "query", F.lit(1 << 60)))).where("kind = 'query'").select("snapshot_id", "state")


@_query(
    f"WITH o AS ({_ORDERS}), f AS (SELECT sid, min(id) AS first FROM o GROUP BY sid) SELECT o.sid AS snapshot_id, CAST(500 + coalesce(sum(v) FILTER (id > first), 0) AS BIGINT) AS state, CAST(500 AS BIGINT) AS before FROM o JOIN f ON f.sid = o.sid GROUP BY o.sid"
)
def compat_first_snapshot(spark, sf_dir):
    """A snapshot that comes before any event is the base for all times, whatever its own time."""
    orders = _orders(spark, sf_dir)
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    rest = orders.join(first, "o_custkey").where("o_orderkey > first")
    log = _events_log(rest).withColumn("seq", F.col("seq") + (1 << 40)).unionByName(_log(first, F.col("o_custkey"), "snapshot", F.lit(1 << 59), F.lit(500)))
    log = log.unionByName(_log(first, F.lit(1 << 50), "query", F.lit(1 << 60))).unionByName(_log(first, F.lit((1 << 50) + 1), "query", F.lit(-(1 << 60))))
    got = replay(log).where("kind = 'query'")
    return got.groupBy("snapshot_id").agg(F.max(F.when(F.col("time") > 0, F.col("state"))).alias("state"), F.max(F.when(F.col("time") < 0, F.col("state"))).alias("before"))


#: Advanced by the time at which a third of each 150 events lies behind: what no checkpoint has kept is lost.
_ADVANCED = (
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY tm, id) AS n, count(*) FILTER (tm < timestamp '1995-01-01') OVER (PARTITION BY sid) AS d, count(*) OVER (PARTITION BY sid) AS total FROM ({log})) "
    "SELECT sid AS snapshot_id, CAST(coalesce(sum(v) FILTER (total - total % 10 > d OR n <= d - d % 10 OR n > d), 0) AS BIGINT) AS state FROM r GROUP BY sid"
)


def _advance_log(spark, sf_dir) -> DataFrame:
    """All orders, one advance for everyone to 1995, one query an entity."""
    orders = _orders(spark, sf_dir)
    log = _commands(orders, "o_custkey", "o_orderdate", "o_orderkey", F.expr(CENTS), F.col("o_orderkey"))
    to = F.unix_micros(F.expr("CAST(timestamp_ntz'1995-01-01 00:00:00' AS timestamp)"))
    return log.unionByName(_log(spark.range(1), F.lit(1 << 49), "advance", delta=to, sid=None))


@_query(_ADVANCED.format(log=_ORDERS))
def compat_advance(spark, sf_dir):
    """An advance without an entity prunes all; events behind the horizon that no checkpoint holds are lost."""
    return replay(_advance_log(spark, sf_dir), interval=10).where("kind = 'query'").select("snapshot_id", "state")


@_query(_ADVANCED.format(log=_ORDERS))
def stream_advance(spark, sf_dir):
    """The same advance on a stream."""
    return _streamed(spark, _advance_log(spark, sf_dir), interval=10).where("kind = 'query'").select("snapshot_id", "state")


@_query(f"SELECT sid AS snapshot_id, CAST(sum(v + {1 << 60}) - 3 * (sum(v + {1 << 60}) // 3) AS BIGINT) AS rest, CAST(count(*) AS BIGINT) AS n FROM (SELECT sid, tm, id + {1 << 53} AS id, v FROM ({_ORDERS}) WHERE id % 4 < 2) GROUP BY sid")
def compat_large_ids(spark, sf_dir):
    """Ids beyond 2 ** 53 that differ by one, and values that add up beyond it, beside the nulls of other commands."""
    orders = _orders(spark, sf_dir).where("o_orderkey % 4 < 2")
    log = _commands(orders, "o_custkey", "o_orderdate", "o_orderkey", F.expr(CENTS), F.col("o_orderkey"))
    log = log.withColumn("event_id", F.col("event_id") + (1 << 53))
    fold = Fold(start=lambda _: 0, step=_mod3)
    got = replay(log, fold).where("kind = 'query'")
    return got.select("snapshot_id", (F.col("state") % 4).alias("rest"), F.shiftright("state", 2).alias("n"))


def _mod3(state: int, value: int) -> int:
    """State packs (events so far, sum of values + 2 ** 60 modulo 3): a value that lost its last digits shows."""
    return ((state >> 2) + 1) << 2 | ((state & 3) + value + (1 << 60)) % 3


@_query(f"SELECT sid AS snapshot_id, epoch_us(tm) AS from_time, epoch_us(latest) AS to_time FROM (SELECT *, max(tm) OVER (PARTITION BY sid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ({_ORDERS})) WHERE tm < latest")
def compat_changes(spark, sf_dir):
    log = _commands(_orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey", F.expr(CENTS), F.col("o_orderkey"))
    return replay(log).where("kind = 'change'").select("snapshot_id", "from_time", "to_time")


def _streamed(spark: SparkSession, log: DataFrame, **options) -> DataFrame:
    """Results of a log that comes in as a stream, in two micro-batches by arrival."""
    from tidefold.sources.checkpoints import scratch
    from tidefold.streaming.processor import configure, live

    configure(spark)
    folder = scratch(spark, "stream")
    middle = log.agg(F.expr("percentile_approx(seq, 0.5, 100)")).first()[0] or 0
    for part in (log.where(F.col("seq") <= middle), log.where(F.col("seq") > middle)):
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        running = live(source, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@_query(f"SELECT sid AS snapshot_id, CAST(sum(CASE WHEN event_type IN ('error', 'view') THEN -v ELSE v END) AS BIGINT) AS state, true AS found FROM ({_EVENTS}) GROUP BY sid")
def streaming_equals_batch(spark, sf_dir):
    """The processor on a live stream of all events."""
    log = _commands(_events(spark, sf_dir), "user_id", "ts", "event_id", F.expr(SIGNED), F.col("event_id"))
    return _streamed(spark, log).where("kind = 'query'").select("snapshot_id", "state", "found")


@_query(
    f"WITH e AS ({_EVENTS}) SELECT 'account' AS lane, sid, CAST(sum(CASE WHEN event_type = 'purchase' THEN v ELSE -v END) AS BIGINT) AS number, '' AS last FROM e WHERE event_type IN ('purchase', 'error') GROUP BY sid "
    "UNION ALL SELECT 'kind', CAST(length(event_type) AS BIGINT), CAST(count(*) AS BIGINT), max_by(event_type, struct_pack(a := tm, b := id)) FROM e GROUP BY length(event_type)"
)
def typed_lanes(spark, sf_dir):
    """One log, two types of state: events fold into accounts by user and into tallies by the length of their kind."""
    engine = op.Lanes({
        "account": (StateSpec("sid", "ts", "event_id", "event_id", {"balance": Sum("CASE WHEN event_type = 'purchase' THEN cents ELSE -cents END")}), F.col("user_id"), F.col("event_type").isin("purchase", "error")),
        "kind": (StateSpec("sid", "ts", "event_id", "event_id", {"n": Count(), "last": Last("event_type")}), F.length("event_type").cast("bigint"), None),
    })
    states = engine.at(_events(spark, sf_dir).withColumn("cents", F.expr(EVENT_CENTS)), F.expr(END))
    accounts, kinds = engine.lane(states, "account"), engine.lane(states, "kind")
    return accounts.select(F.lit("account").alias("lane"), "sid", F.col("balance").alias("number"), F.lit("").alias("last")).unionByName(kinds.select(F.lit("kind").alias("lane"), "sid", F.col("n").alias("number"), "last"))


@_query("SELECT CASE WHEN l_returnflag = 'R' THEN 'order' ELSE 'supplier' END AS lane, CAST(CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE l_suppkey END AS BIGINT) AS sid, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def first_target(spark, sf_dir):
    """The entity that an event is named after: its first target in the order of the lanes."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_returnflag")
    spec = StateSpec("sid", "l_shipdate", "l_orderkey", "l_orderkey", {"n": Count()})
    engine = op.Lanes({"order": (spec, F.col("l_orderkey"), F.col("l_returnflag") == "R"), "supplier": (spec, F.col("l_suppkey"), None)})
    return engine.first_target(lines).groupBy("lane", "sid").agg(F.count("*").alias("n"))
