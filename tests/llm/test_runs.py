"""Periodic runs against a plain version, and the query's columns against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries
from tracewell.llm.runs import collapse, find_runs, periodic_runs

DOCS = "doc_id long, text string"


def plain(words, exponent=4, least=6):
    """Every period, every stretch, and whether a smaller period would do."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            size = end - k + q
            part = words[k : k + size]
            if end > k and size >= max(least, exponent * q) and not any(all(part[j] == part[j + p] for j in range(size - p)) for p in range(1, q)):
                found.append((k, size, q))
            k = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng, n, alphabet):
    out = []
    while len(out) < n:
        out += [rng.randrange(alphabet) for _ in range(rng.randint(1, 5))] * rng.randint(2, 7) if rng.random() < 0.4 else [rng.randrange(alphabet)]
    return [b"w%d" % w for w in out]


def test_equal_to_every_period_of_every_stretch():
    rng, some = random.Random(5), 0
    for _ in range(1500):
        words = repetitive(rng, rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5]))
        exponent, least = rng.choice([2, 3, 4, 4]), rng.choice([2, 6])
        want = plain(words, exponent, least)
        assert find_runs(words, exponent, least) == want
        some += len(want)
    assert some > 2000
    with pytest.raises(ValueError, match="two periods"):
        find_runs([b"a"] * 9, exponent=1)


def test_long_texts_are_linear_enough():
    assert find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    words = [b"%d" % (k % 7000) for k in range(100_000)]
    assert find_runs([b"x", *words, b"y"]) == [(1, 100_000, 7000)]


def test_first_periods_stay():
    assert collapse([b"a"] * 7 + [b"b"], [(0, 7, 1)]) == [b"a", b"b"]
    assert collapse([b"a", b"b"] * 4, [(0, 8, 2)]) == [b"a", b"b"]


def want_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {k for s, size, q in found for k in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_query_on_nulls_copies_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(w.decode() for w in repetitive(rng, rng.randint(0, 80), rng.choice([2, 4, 400])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t\x0b\x0c\r"), (None, "x " * 9), (3, "other text of an id"), (503, "É\xa0  " * 8), (504, "a\x85b " * 6), *rows[:5]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("y") for c in ("id", "runs", "collapsed", "n_runs")}).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op13_periodic_runs(spark, "")
    want = [want_of(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 30
    monkeypatch.setattr(queries, "table", lambda *_: docs.limit(0))
    assert queries.op13_periodic_runs(spark, "").collect() == []


def test_operator_keeps_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "go go go go go go now")], DOCS)
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1)] and row["collapsed"] == "go now"
