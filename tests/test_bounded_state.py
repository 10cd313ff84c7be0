"""Sessions of a stream that end when idle."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.streaming import stateful

ROWS = "session_id string, call_index long, event_id long, sha string, at timestamp"
HOUR = 3_600_000


def plain(rows, idle):
    """Decisions one by one."""
    out, state = [], {}
    for session, at, event, sha, time in sorted(rows, key=lambda r: (r[0], r[1])):
        newest, seen = state.get(session, (None, {}))
        if newest and (time - newest).total_seconds() * 1000 > idle:
            seen = {}
        first = sha not in seen
        seen.setdefault(sha, (len(seen) + 1, at))
        state[session] = (max(newest or time, time), seen)
        out.append((session, at, event, first, *seen[sha]))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_idle_sessions_end_however_the_stream_is_cut(spark, tmp_path, files):
    rng = random.Random(5)
    rows, start = [], dt.datetime(2024, 1, 1)
    for s in range(6):
        time = start
        for k in range(40):
            time += dt.timedelta(minutes=rng.choice((1, 5, 30, 30, 61, 200)))
            rows.append((f"s{s}", k, len(rows), rng.choice("abc"), time))
    # one record long after all others: every other session is over by then
    rows.append(("last", 0, len(rows), "a", start + dt.timedelta(days=30)))
    rows.sort(key=lambda r: r[4])
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = stateful.first_deliveries(stream, stateful.Bounds("at", HOUR))
    q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(stateful.FIRST).parquet(f"{tmp_path}/out").collect())
    assert got == plain(rows, HOUR)
    assert sum(r[3] for r in got) > 20
    held = spark.read.format("statestore").option("stateVarName", "newest").load(f"{tmp_path}/state")
    assert [r["session_id"] for r in held.select(F.col("key.session_id")).collect()] == ["last"]


def test_an_entry_is_asked_for_once():
    class Held:
        asked = 0

        def getValue(self, key):
            self.asked += 1
            return {("a",): (1, 2)}.get(key)

    held, step = Held(), stateful._First()
    step.cache = {}
    assert [step.look(held, (k,)) for k in ("a", "b", "a", "b")] == [(1, 2), None, (1, 2), None]
    assert held.asked == 2


class Store:
    """Value and map states of one session in a plain folder of names, with the requests made."""

    def __init__(self):
        self.held, self.asked = {}, []

    def getValueState(self, name, _):
        return Variable(self, name)

    def getMapState(self, name, *_):
        return Variable(self, name)


class Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.store.asked.append((self.name, key))
        return self.store.held.get((self.name, key))

    def updateValue(self, key, value):
        self.store.asked.append((self.name, key))
        self.store.held[self.name, key] = value

    def clear(self):
        self.store.asked.append((self.name, "clear"))
        self.store.held = {k: v for k, v in self.store.held.items() if k[0] != self.name}


def in_batches(rows, size, step, store):
    out = []
    for k in range(0, len(rows), size):
        step.init(store)
        out += [tuple(r) for r in step.handleInputRows(("s",), iter(rows[k : k + size]), None)]
    return out


def test_a_batch_of_a_small_session_is_one_request_each_way():
    store, seen = Store(), Row("call_index", "event_id", "sha")
    rows = [seen(k, k, f"c{k % 40}") for k in range(100)]
    got = in_batches(rows, 50, stateful._First(), store)
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [(k, k < 40, k % 40 + 1, k % 40) for k in range(100)]
    assert len(store.asked) == 4


@pytest.mark.parametrize(("width", "size"), [(1, 7), (3, 64), (8, 1000)])
def test_pages_part_as_a_session_grows(monkeypatch, width, size):
    monkeypatch.setattr(stateful._Pages, "WIDTH", width)
    rng, store, record = random.Random(width), Store(), Row("record_index", "event_id", "is_call", "call_id")
    rows = [record(k, k, rng.random() < 0.6, f"é{rng.randrange(300)}") for k in range(900)]
    waiting, want = {}, []
    for r in rows:
        held = waiting.get(r.call_id)
        if held != "done" and r.is_call:
            waiting[r.call_id] = r.event_id
        elif held not in (None, "done"):
            want.append(("s", r.call_id, held, r.event_id))
            waiting[r.call_id] = "done"
    assert in_batches(rows, size, stateful._Pairs(), store) == want
    pages = [json.loads(v[0]) for (name, _), v in store.held.items() if name == "pending"]
    assert sum(map(len, pages)) == len(waiting) <= width * len(pages)


def test_pages_of_an_ended_session_go():
    store = Store()
    pages = stateful._Pages(store.getMapState("seen"))
    for n in range(600):
        pages.updateValue((f"k{n}",), (n, n))
    held = pages.close()
    assert held == (4, 600, None) and len(store.held) == 4
    pages.open(*held)
    assert pages.getValue(("k5",)) == (5, 5)
    pages.clear()
    assert pages.getValue(("k5",)) is None
    pages.updateValue(("new",), (1, 1))
    held = pages.close()
    assert held[:2] == (1, 1) and not store.held
    pages.open(*held)
    assert pages.getValue(("new",)) == (1, 1)
