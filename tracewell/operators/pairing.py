"""Calls and outputs paired through a queue of bounded length.

A call waits from its record to the first output of its id. A call of an id that is waiting takes
the place of the older one. If more than ``pending`` calls wait, the oldest is given up. Calls that have found
their output no longer count.

What becomes of a call depends only on records after it, as older calls are always given up first. So
every range of a session's records is worked through on its own from an empty queue, which decides all
its calls but the at most ``pending`` that still wait at its end. Those meet the ranges after them in
short: the first record of each of their ids, and how many calls had waited at most until then. Ranges, and
sessions' summaries, are run through in order, and a session of any length is spread over its ranges.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tracewell.sources.scratch import Steps
from tracewell.sources.ship import ship

_STATE = "session_id call_id call_index state output_index"
_PART = "session_id part kind call_id at is_call peak state output_index"
_TYPES = {"kind": StringType(), "state": StringType(), "is_call": BooleanType()} | {c: LongType() for c in ("part", "at", "peak", "call_index", "output_index")}


class Queue:
    """Waiting calls, oldest first."""

    def __init__(self, pending: int):
        self.pending, self.waiting, self.peak = pending, OrderedDict(), 0

    def take(self, call_id, at: int, is_call: bool) -> list[tuple]:
        """(call id, its place, state, place of the output) of every call that this record settles."""
        held = self.waiting.pop(call_id, None)
        if not is_call:
            return [] if held is None else [(call_id, held, "PAIRED", at)]
        settled = [] if held is None else [(call_id, held, "REPLACED", None)]
        self.waiting[call_id] = at
        if len(self.waiting) > self.pending:
            settled.append((*self.waiting.popitem(last=False), "EVICTED", None))
        self.peak = max(self.peak, len(self.waiting))
        return settled


class _Ranges:
    """Ranges one after another: settled calls, first records of ids with the peak before them, and what waits at the end of each."""

    def __init__(self, pending: int):
        self.pending, self.queue, self.seen = pending, Queue(pending), set()

    def take(self, call_id, at: int, is_call: bool, *_) -> list[tuple]:
        out = []
        if call_id not in self.seen:
            self.seen.add(call_id)
            out.append(("FIRST", call_id, at, is_call, self.queue.peak, None, None))
        return out + [("SETTLED", c, i, True, None, state, o) for c, i, state, o in self.queue.take(call_id, at, is_call)]

    def end(self) -> list[tuple]:
        out = [("WAITING", c, i, True, None, None, None) for c, i in self.queue.waiting.items()]
        out.append(("END", None, None, None, self.queue.peak, None, None))
        self.queue, self.seen = Queue(self.pending), set()
        return out


class _Sessions:
    """Calls that were waiting at the end of a range, followed through the summaries of those after it, session by session."""

    def __init__(self, pending: int):
        self.pending, self.old = pending, OrderedDict()

    def take(self, kind: str, call_id, at: int | None, is_call: bool | None, peak: int | None, *_) -> list[tuple]:
        if kind == "WAITING":
            self.old[call_id] = at
            return []
        out = []
        while self.old and peak + len(self.old) > self.pending:
            out.append((*self.old.popitem(last=False), "EVICTED", None))
        if kind == "FIRST" and call_id in self.old:
            out.append((call_id, self.old.pop(call_id), *(("REPLACED", None) if is_call else ("PAIRED", at))))
        return out

    def end(self) -> list[tuple]:
        out = [(c, i, "WAITING", None) for c, i in self.old.items()]
        self.old = OrderedDict()
        return out


def _through(rows: DataFrame, by: list[str], order: list[str], kind: type, pending: int, schema: StructType) -> DataFrame:
    """What ``kind`` makes of the rows of each key in order, behind the key.

    Spark sorts the rows, and a task runs through its keys in Arrow batches: a small key costs no more than its rows.
    """
    n, out = len(by), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, made = kind(pending), None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if key is not None:
                        made += [key + m for m in held.end()]
                    key = row[:n]
                made += [key + m for m in held.take(*row[n:])]
            yield _batch(made, out)
            made = []
        if key is not None:
            yield _batch([key + m for m in held.end()], out)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def bounded_pairs(records: DataFrame, pending: int, width: int = 1 << 16) -> DataFrame:
    """Per call of ``records`` (session_id, record_index, call_id, is_call): ``state`` and ``output_index``.

    States: PAIRED; EVICTED; REPLACED, called again while it waited; WAITING, without an output to the
    end; UNPLACED, without session, id or place. Outputs that find no waiting call settle nothing. At
    equal places calls come first.
    """
    ship(records.sparkSession)
    kinds = {c: records.schema[c].dataType for c in ("session_id", "call_id")}
    typed = lambda spec: StructType([StructField(c, kinds.get(c) or _TYPES[c]) for c in spec.split()])
    rows = records.select("session_id", "call_id", F.col("record_index").cast("long").alias("at"), F.coalesce("is_call", F.lit(False)).alias("is_call"))
    unplaced = F.col("session_id").isNull() | F.col("call_id").isNull() | F.col("at").isNull()
    lost = rows.where(unplaced & F.col("is_call")).select("session_id", "call_id", F.col("at").alias("call_index"), F.lit("UNPLACED").alias("state"), F.lit(None).cast("long").alias("output_index"))
    placed = rows.where(~unplaced).select("session_id", F.floor(F.col("at") / width).alias("part"), "call_id", "at", "is_call", (~F.col("is_call")).alias("_late"))

    # what is made of the ranges is read four times, but made once
    ranges = _through(placed, ["session_id", "part"], ["at", "_late", "call_id"], _Ranges, pending, typed(_PART))
    parts = Steps(records.sparkSession, "ranges").append(ranges)
    waiting = parts.where("kind = 'WAITING'")
    touched = parts.where("kind = 'FIRST'").join(waiting.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_semi").select(parts.columns)
    summary = waiting.union(touched).union(parts.where("kind = 'END'")).select("session_id", "kind", "call_id", "at", "is_call", "peak", "part", F.when(F.col("kind") == "FIRST", 0).when(F.col("kind") == "END", 1).otherwise(2).alias("_step"))
    rest = _through(summary, ["session_id"], ["part", "_step", "at"], _Sessions, pending, typed(_STATE))
    settled = parts.where("kind = 'SETTLED'").select("session_id", "call_id", F.col("at").alias("call_index"), "state", "output_index")
    return settled.union(rest).union(lost)
