"""Decisions made record by record as sessions arrive, with keyed state that outlives restarts.

State is kept by session, one entry for each content, view or call id. Entries lie in pages of bounded size, as each
request to the state store costs far more than what it carries: a small session is read and written in one, and of a
long one only the pages that a batch names. Records must arrive in order within a session, as a log gives them; rows
of one batch are put in order here, and a record that is replayed is dropped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.sources.ship import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_map_state(spark: SparkSession) -> None:
    """Ship the package and choose the state store that holds map state."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@dataclass(frozen=True)
class Bounds:
    """When a session ends: the column of event times, milliseconds without a record, and how late records may come."""

    time: str
    idle: int
    late: str = "0 seconds"


class _Pages:
    """Entries of one session, dealt over pages by a hash of their keys.

    While there is one page it lies beside the session's counters (``single``); more are in map state. Where pages would hold
    more than WIDTH entries on average, all are dealt anew over four times as many, so that an entry is moved a bounded number of times.
    """

    WIDTH = 256

    def __init__(self, stored) -> None:
        self.stored = stored
        self.open()

    def open(self, pages: int = 1, entries: int = 0, single: str | None = None) -> None:
        """The session as its last batch left it."""
        self.pages, self.entries, self.stale, self.changed = pages, entries, False, set()
        self.read: dict[int, dict] = {0: self._parse(single)} if pages == 1 else {}

    @staticmethod
    def _parse(text: str | None) -> dict[tuple, tuple]:
        return {tuple(k): tuple(v) for k, v in json.loads(text)} if text else {}

    def _number(self, key: tuple) -> int:
        return zlib.crc32(json.dumps(key).encode()) % self.pages

    def _page(self, number: int) -> dict[tuple, tuple]:
        if number not in self.read:
            # what was cleared in this batch is not read again
            held = None if self.stale else self.stored.getValue((number,))
            self.read[number] = self._parse(held[0] if held else None)
        return self.read[number]

    def getValue(self, key: tuple) -> tuple | None:
        return self._page(self._number(key)).get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        number = self._number(key)
        page = self._page(number)
        self.entries += key not in page
        page[key] = value
        self.changed.add(number)

    def clear(self) -> None:
        """No entries any more; what is stored goes when the batch is done."""
        stale = self.stale or self.pages > 1
        self.open()
        self.stale = stale

    def close(self) -> tuple[int, int, str | None]:
        """Write what has changed; what ``open`` takes next time."""
        if self.stale:
            self.stored.clear()
        if self.entries > self.WIDTH * self.pages:
            every = [e for n in range(self.pages) for e in self._page(n).items()]
            while self.entries > self.WIDTH * self.pages:
                self.pages *= 4
            self.read = {n: {} for n in range(self.pages)}
            for key, value in every:
                self.read[self._number(key)][key] = value
            self.changed = set(self.read)
        text = lambda n: json.dumps(list(self.read[n].items()), separators=(",", ":"))
        if self.pages == 1:
            return 1, self.entries, text(0)
        for n in self.changed:
            self.stored.updateValue((n,), (text(n),))
        return self.pages, self.entries, None


class _Ordered(StatefulProcessor):
    """Rows of a batch in order, without those decided before."""

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long, receipts long, newest long, pages long, entries long, single string")
        self.newest = handle.getValueState("newest", "at long") if self.idle is not None else None
        self.state = _Pages(handle.getMapState(self.name, "page long", "entries string"))

    def decide(self, row, receipts: int) -> tuple[tuple | None, int]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, receipts, newest, *held = self.last.get() or (-1, 0, None)
        before = newest
        self.state.open(*held)
        out = []
        self.cache: dict = {}
        for row in sorted(rows, key=itemgetter(self.order)):
            at = int(row[self.order])
            if at > last:
                if self.newest and row.event_ms is not None:
                    if newest is not None and row.event_ms - newest > self.idle:
                        self.forget()
                        receipts = 0
                    newest = int(row.event_ms) if newest is None else max(newest, int(row.event_ms))
                made, receipts = self.decide(row, receipts)
                last = at
                if made is not None:
                    out.append((key[0], *made))
        self.flush()
        self.last.update((last, receipts, newest, *self.state.close()))
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(newest + self.idle)
            self.newest.update((newest,))
        yield from map(self.made, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.stored.clear()
        self.last.clear()
        self.newest.clear()
        yield from ()

    def made(self, values: tuple) -> Row:
        return Row(**dict(zip(self.columns, values)))

    def forget(self) -> None:
        """The session's entries go, those not yet written as well."""
        self.cache = {}
        self.state.clear()

    def look(self, state, key: tuple):
        """An entry, looked for once a batch and put back by ``flush``."""
        if key not in self.cache:
            self.cache[key] = [state.getValue(key), False]
        return self.cache[key][0]

    def put(self, key: tuple, value: tuple) -> None:
        self.cache[key] = [value, True]

    def flush(self) -> None:
        for key, (value, changed) in self.cache.items():
            if changed:
                self.state.updateValue(key, value)

    def close(self) -> None:
        pass


def _by_session(rows: DataFrame, kind: type[_Ordered], schema: str, bounds: Bounds | None) -> DataFrame:
    use_map_state(rows.sparkSession)
    if bounds is None:
        return rows.groupBy("session_id").transformWithState(kind(), schema, "Append", "None")
    timed = rows.withWatermark(bounds.time, bounds.late).withColumn("event_ms", F.unix_millis(F.col(bounds.time).cast("timestamp")))
    return timed.groupBy("session_id").transformWithState(kind(bounds.idle), schema, "Append", "EventTime")


class _First(_Ordered):
    # an entry: sha -> receipt, place
    name, order, columns = "seen", "call_index", ["session_id", "call_index", "event_id", "is_first", "receipt_no", "first_index"]

    def decide(self, row, receipts):
        held = self.look(self.state, (row.sha,))
        first = held is None
        if first:
            receipts += 1
            held = (receipts, int(row.call_index))
            self.put((row.sha,), held)
        return (int(row.call_index), int(row.event_id), first, *held), receipts


FIRST = "session_id string, call_index long, event_id long, is_first boolean, receipt_no long, first_index long"


def first_deliveries(calls: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Per arriving call: whether its content is new to the session, the receipt, and where it was first."""
    return _by_session(calls, _First, FIRST, bounds)


class _Reads(_Ordered):
    # an entry: source, view -> receipt, sha, place
    name, order, columns = "receipts", "call_index", ["session_id", "call_index", "event_id", "decision", "receipt_no", "distance"]

    def decide(self, row, receipts):
        at = int(row.call_index)
        if row.source is None or row.view is None:
            return (at, int(row.event_id), "SOURCE_UNKNOWN" if row.source is None else "VIEW_UNKNOWN", None, None), receipts
        key = (row.source, row.view)
        held = self.look(self.state, key)
        if held is None:
            receipts += 1
            self.put(key, (receipts, row.sha, at))
            return (at, int(row.event_id), "FIRST_READ", receipts, None), receipts
        number, sha, seen = held
        reference = len(f"[[READ receipt=rcpt-{number:04d} sha256={row.sha} bytes={row.n_bytes}]]")
        decision = "SOURCE_CHANGED" if sha != row.sha else "NOT_ECONOMIC" if reference >= row.n_bytes else "HISTORICAL_IDENTICAL"
        # a repeat that is not economic leaves the receipt as it was
        if decision != "NOT_ECONOMIC":
            self.put(key, (number, row.sha, at))
        return (at, int(row.event_id), decision, number, at - seen), receipts


READS = "session_id string, call_index long, event_id long, decision string, receipt_no long, distance long"


def read_receipts(reads: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Per arriving read (source, view, sha, n_bytes): the decision of ``operators.receipts``, made one by one."""
    return _by_session(reads, _Reads, READS, bounds)


class _Pairs(_Ordered):
    # an entry: call id -> event; -1: the id is done
    name, order, columns = "pending", "record_index", ["session_id", "call_id", "call_event", "output_event"]

    def decide(self, row, receipts):
        key = (row.call_id,)
        held = self.look(self.state, key)
        if held is not None and held[0] < 0:
            return None, receipts
        if row.is_call:
            self.put(key, (int(row.event_id),))
            return None, receipts
        if held is None:
            return None, receipts
        self.put(key, (-1,))
        return (row.call_id, held[0], int(row.event_id)), receipts + 1


PAIRS = "session_id string, call_id string, call_event long, output_event long"


def pair_calls(records: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Each call id once: the first output that arrives after a call, with the call that arrived last before it."""
    return _by_session(records, _Pairs, PAIRS, bounds)
