"""The machine on a live command stream: keyed state in transformWithState, one tagged output stream.

Entities are dealt to shards; a shard is a group of the stateful step and holds its entities' timelines in RocksDB
(`configure`), one entry each, long ones in several. Commands travel packed as numbers, many a row: pandas would pass
numbers beside nulls through floating point, and a row, a group or a message to the state store for each command is
what costs time. Late events are never dropped, so there is no watermark. Within a micro-batch commands run in order
of seq; across batches order is that of the stream.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidefold.plans import machine, replay
from tidefold.plans.machine import Fold, Timeline
from tidefold.plans.replay import RESULTS, apply, signed_sum

#: A part of an entity's timeline; part 0 is its head.
_PART = StructType([StructField("id", LongType()), StructField("part", LongType())])
_BLOB = StructType([StructField("data", BinaryType())])
_TYPES = {c.split()[0]: {"bigint": "Int64", "string": "object", "boolean": "boolean"}[c.split()[1]] for c in RESULTS.split(", ")}
_OPS = ["event", "snapshot", "advance", "query"]
_ADVANCE, _QUERY = _OPS.index("advance"), _OPS.index("query")
#: Numbers of a packed command, and those of them that may be null, by bits of a mask.
_NUMBERS = ["seq", "snapshot_id", "time", "event_id", "value", "delta"]
_COMMAND = np.dtype([(n, "<i8") for n in _NUMBERS] + [("op", "u1"), ("null", "u1")])
#: Commands packed together, and result rows handed over together.
_ROWS = 1 << 17
_OUT = 1 << 13
#: Bytes of a timeline that is written whole; what a longer one gains or loses is written in parts of this size at least.
_WHOLE = 1 << 16


def configure(spark: SparkSession) -> None:
    """State in RocksDB, as transformWithState asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def pack(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Commands with their shard, as (shard, blob); a command without a shard goes to all of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= _ROWS:
            yield _packed(held, shards)
            held, size = [], 0
    if size:
        yield _packed(held, shards)


def _packed(batches: list[pa.RecordBatch], shards: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    code = pc.index_in(t["op"], pa.array(_OPS))
    if code.null_count:
        raise ValueError(f"unknown op {t['op'].filter(pc.is_null(code))[0].as_py()!r}")
    numbers = [t[n].cast(pa.int64()) for n in _NUMBERS]
    mask = sum(pc.is_null(c).to_numpy().astype("u1") << i for i, c in enumerate(numbers))
    table = np.empty(t.num_rows, _COMMAND)
    for n, c in zip(_NUMBERS, numbers, strict=True):
        table[n] = c.fill_null(0).to_numpy()
    table["op"], table["null"] = code.to_numpy(), mask
    shard = t["shard"].fill_null(-1).to_numpy()
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(-1, shards + 1))
    everywhere = table[order[: cuts[1]]]
    rows = [(s, everywhere.tobytes() + table[order[cuts[s + 1] : cuts[s + 2]]].tobytes()) for s in range(shards) if len(everywhere) or cuts[s + 1] < cuts[s + 2]]
    return pa.record_batch([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "blob"])


def unpack(blobs: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), _COMMAND)


def commands_of(table: np.ndarray) -> list[dict]:
    """Packed commands as `apply` reads them."""
    null = table["null"].tolist()
    columns = [[None if m & bit else x for x, m in zip(table[n].tolist(), null, strict=True)] if any(m & bit for m in null) else table[n].tolist() for n, bit in zip(_NUMBERS, (1 << i for i in range(len(_NUMBERS))), strict=True)]
    names = ("op", *_NUMBERS)
    return [dict(zip(names, row, strict=True)) for row in zip([_OPS[x] for x in table["op"].tolist()], *columns, strict=True)]


#: What a timeline gains and loses: entries by (0 for events or 1 for marks, time, id), and keys that go before they come.
Delta = tuple[dict, set]


def merged(old: Delta, new: Delta) -> Delta:
    put = {k: v for k, v in old[0].items() if k not in new[1]} | new[0]
    return put, (old[1] | new[1]) - put.keys()


def _entries(events: dict, marks: dict) -> dict:
    return {(0, *k): v for k, v in events.items()} | {(1, *k): v for k, v in marks.items()}


class TimelineProcessor(StatefulProcessor):
    """One shard of entities. An entity's head holds its base and clock, and a short timeline whole; of a long one the
    head holds the latest changes, and parts of falling size those before: an entry is written again as often as the
    logarithm of its timeline's length, however small the batches are."""

    def __init__(self, fold: Fold | None = None, horizon: int = 0, interval: int = 100) -> None:
        self.fold, self.horizon, self.interval = fold or signed_sum(), horizon, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", _PART, _BLOB)

    def _load(self, sid: int) -> tuple[Timeline, list[int], Delta]:
        """The timeline, the sizes of its parts, and the changes that came after them."""
        base, clock, sizes, tail = pickle.loads(self.lines.getValue((sid, 0))[0])
        whole: Delta = ({}, set())
        for n in range(len(sizes)):
            whole = merged(whole, pickle.loads(self.lines.getValue((sid, n + 1))[0]))
        events, marks = {}, {}
        for (kind, *key), value in merged(whole, tail)[0].items():
            (marks if kind else events)[tuple(key)] = value
        return Timeline(sid, self.fold, base, self.horizon, self.interval, clock, sorted(events), events, sorted(marks), marks), sizes, tail

    def _store(self, line: Timeline, sizes: list[int], tail: Delta, before: dict) -> None:
        now = _entries(line.events, line.marks)
        if 2 * len(now) < sum(sizes):  # most of it went: written anew
            tail, sizes, old = (now, set()), [], sizes
        elif sizes:
            old = sizes
            tail = merged(tail, ({k: v for k, v in now.items() if k not in before or before[k] is not v}, before.keys() - now.keys()))
        else:
            tail, sizes, old = (now, set()), [], sizes
        head = pickle.dumps((line.base, line.clock, sizes, tail))
        if len(head) > _WHOLE:  # to a part of its own, with those before that aren't larger
            sizes = list(sizes)
            while sizes and sizes[-1] <= len(tail[0]) + len(tail[1]):
                tail = merged(pickle.loads(self.lines.getValue((line.sid, len(sizes)))[0]), tail)
                sizes.pop()
            if not sizes:
                tail = (tail[0], set())
            sizes.append(len(tail[0]) + len(tail[1]))
            self.lines.updateValue((line.sid, len(sizes)), (pickle.dumps(tail),))
            head = pickle.dumps((line.base, line.clock, sizes, ({}, set())))
        for n in range(len(sizes), len(old)):
            self.lines.removeKey((line.sid, n + 1))
        self.lines.updateValue((line.sid, 0), (head,))

    def _run(self, sid: int, log: np.ndarray, known: bool) -> list[tuple]:
        """Results of one entity's commands, in order of seq."""
        line, sizes, tail = self._load(sid) if known else (None, [], ({}, set()))
        before = _entries(line.events, line.marks) if sizes else {}
        out = []
        for row in commands_of(log):
            row["snapshot_id"] = sid
            line, result = apply(line, row, self.fold, self.horizon, self.interval)
            if result:
                out.append(result)
        if line and (log["op"] != _QUERY).any():
            self._store(line, sizes, tail, before)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = unpack(blob for frame in rows for blob in frame["blob"])
        log = log[np.argsort(log["seq"], kind="stable")]
        nobody = (log["null"] >> _NUMBERS.index("snapshot_id") & 1).astype(bool)
        if (log["op"][nobody] != _ADVANCE).any():
            raise ValueError("only an advance may come without an entity")
        # an advance for everyone reaches the entities of this batch, which it finds or not, and all that are stored
        moves, log = log[nobody], log[~nobody]
        log = log[np.argsort(log["snapshot_id"], kind="stable")]
        names, begin = np.unique(log["snapshot_id"], return_index=True)
        names, begin = names.tolist(), [*begin.tolist(), len(log)]
        stored = {k[0] for k in self.lines.keys() if k[1] == 0} if len(moves) else None
        out = []
        for sid, a, z in zip(names, begin[:-1], begin[1:], strict=True):
            own = log[a:z]
            if len(moves):
                own = np.concatenate((own, moves))
                own = own[np.argsort(own["seq"], kind="stable")]
            out += self._run(sid, own, self.lines.containsKey((sid, 0)) if stored is None else sid in stored)
            if len(out) >= _OUT:
                yield _frame(out)
                out = []
        for sid in sorted((stored or set()).difference(names)):
            self._run(sid, moves, True)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(out: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*out, strict=True)) if out else [()] * len(_TYPES)
    return pd.DataFrame({name: pd.array(list(c), dtype) for (name, dtype), c in zip(_TYPES.items(), columns, strict=True)})


def live(commands: DataFrame, fold: Fold | None = None, horizon: int = 0, interval: int = 100, shards: int = 256) -> DataFrame:
    """A stream of results (RESULTS) for a stream of commands; kind tells query results from changes.

    Advances without an entity reach every entity known when they come, as in a batch: each goes to all `shards` by
    which entities are dealt. `shards` bounds the step's parallelism and must stay the same over a stream's life; a
    task holds the packed commands of one shard and micro-batch, and one timeline.
    """
    # the process that sets the processor up on the driver doesn't share its import path: send the code along
    for module in (sys.modules[__name__], machine, replay):
        if module.__name__ not in cloudpickle.list_registry_pickle_by_value():
            cloudpickle.register_pickle_by_value(module)
    everywhere = (F.col("op") == "advance") & F.col("snapshot_id").isNull()
    shard = F.when(~everywhere, F.pmod(F.xxhash64("snapshot_id"), F.lit(shards)).cast("int")).alias("shard")
    sent = commands.select(shard, "op", *_NUMBERS).mapInArrow(lambda it: pack(it, shards), "shard int, blob binary")
    return sent.groupBy("shard").transformWithStateInPandas(TimelineProcessor(fold, horizon, interval), RESULTS, "Append", "None")
