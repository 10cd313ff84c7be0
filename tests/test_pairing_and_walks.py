"""Bounded pairing, numbering, containment and walks against plain versions."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tracewell.operators import corpus, discovery, grams, harvest, pairing, walks
from tracewell.plans import streams

RECORDS = "session_id string, record_index long, call_id string, is_call boolean"
SF = "/root/testdata/sf0.001"


def plain_pairs(rows, pending):
    """One session after another, one record after another."""
    out = []
    for session in sorted({r[0] for r in rows}):
        waiting = OrderedDict()
        for _, at, call_id, is_call in sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], not r[3])):
            held = waiting.pop(call_id, None)
            if not is_call:
                if held is not None:
                    out.append((session, call_id, held, "PAIRED", at))
                continue
            if held is not None:
                out.append((session, call_id, held, "REPLACED", None))
            waiting[call_id] = at
            if len(waiting) > pending:
                out.append((session, *waiting.popitem(last=False), "EVICTED", None))
        out += [(session, c, i, "WAITING", None) for c, i in waiting.items()]
    return sorted(out, key=repr)


def paired(spark, rows, pending, width=1 << 16):
    got = pairing.bounded_pairs(spark.createDataFrame(rows, RECORDS).repartition(3), pending, width)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_finished_pairs_do_not_count_as_waiting(spark):
    rows = [("s", 0, "a", True)] + [("s", 1 + 2 * k + o, f"b{k}", o == 0) for k in range(10) for o in (0, 1)] + [("s", 21, "a", False)]
    assert ("s", "a", 0, "PAIRED", 21) in paired(spark, rows, 4)


@pytest.mark.parametrize(("width", "pending"), [(1, 3), (4, 1), (7, 3), (16, 4), (1 << 16, 4)])
def test_ranges_compose_to_the_whole_session(spark, width, pending):
    rng = random.Random(width)
    rows = [(f"s{s}", k, f"c{rng.randrange(4 + s * 3)}", rng.random() < 0.5) for s in range(4) for k in range(150)]
    want = plain_pairs(rows, pending)
    assert paired(spark, rows, pending, width) == want
    assert {r[3] for r in want} == {"PAIRED", "EVICTED", "REPLACED", "WAITING"}


def test_records_without_place_or_id(spark):
    rows = [("s", None, "a", True), ("s", 3, None, True), (None, 1, "x", True), ("s", 4, None, False), ("s", 5, "b", None), ("s", 6, "b", True)]
    assert {(r[1], r[3]) for r in paired(spark, rows, 2)} == {("a", "UNPLACED"), (None, "UNPLACED"), ("x", "UNPLACED"), ("b", "WAITING")}
    assert paired(spark, [], 2) == []


def test_small_sessions_share_tasks_and_ranges_are_made_once(spark):
    records = spark.createDataFrame([(f"s{s}", k, "c", k % 2 == 0) for s in range(50) for k in range(4)], RECORDS)
    got = pairing.bounded_pairs(records, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("ExistingRDD") == 1  # for records without a place
    assert sorted({(r.state, r.call_index, r.output_index) for r in got.collect()}) == [("PAIRED", 0, 1), ("PAIRED", 2, 3)]


def test_streams_carry_state_over_batches(spark):
    batches: list = []
    assert streams.stream_pairing(spark, SF, batches).count() > 20
    assert len(batches) >= 3


def test_rows_without_an_order_are_numbered_first(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 1, 3), ("a", 1 << 40, 4), (None, None, 5)], "k string, o long, n int")
    got = {r["n"]: (r["place"], r["size"]) for r in harvest.number_within(rows, "k", "o", 4, size="size").collect()}
    assert got == {1: (0, 4), 3: (1, 4), 2: (2, 4), 4: (3, 4), 5: (0, 1)}
    with pytest.raises(ValueError, match="place or n"):
        harvest.number_within(rows, "k", "o")
    assert corpus.periodic_sample(rows, "k", "o", 9).count() == 5
    assert harvest.stratified(rows, "k", "o", {"a": 9}).count() == 4


def test_quantiles_of_a_size_called_n(spark):
    rows = spark.createDataFrame([("g", k, n) for k, n in enumerate([3, None, 1, 2])], "g string, k int, n int")
    got = sorted(tuple(r) for r in corpus.quantile_review(rows, "g", "n", "k", (0.0, 1.0)).collect())
    assert got == [("g", 0, 3, 3), ("g", 1, None, 0)]


def test_drive_letters_belong_to_paths(spark):
    row = spark.createDataFrame([(1, "C:\\a.py:1:x\nC:\\b.py:2:y\nd/e.py:3:z\n")], "k int, out string")
    assert harvest.characterise(row, "k", F.col("out")).first()["paths"] == 3


def test_words_are_found_by_their_rarest_trigram(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc/_.") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "ab", "abcabc", "abcabc"]
    words = ["".join(rng.choice("abc/_.") for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None, "abc", "abc", "%a_"]
    got = grams.holding(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    want = {(w, t) for w in words if w and len(w) >= 3 for t in texts if t and w in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def power(nodes, edges, seeds, steps=600):
    n, out = len(nodes), {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
    valid = {k: w for k, w in seeds.items() if k in nodes and w > 0}
    v = {x: valid.get(x, 0.0) / sum(valid.values()) if valid else 1.0 / n for x in nodes}
    p = dict(v)
    for _ in range(steps):
        lost = sum(p[x] for x in nodes if x not in out)
        q = {x: 0.15 * v[x] + 0.85 * lost / n for x in nodes}
        for a, targets in out.items():
            for b in targets:
                q[b] += 0.85 * p[a] / len(targets)
        p = q
    return p


def test_walks_of_many_tasks_equal_power_iteration(spark):
    rng = random.Random(8)
    nodes = [f"n{k}" for k in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)] + [("n0", "n1"), ("n1", "n0")]
    seeds = {"q0": {"n0": 2.0}, "q1": {"n3": 1.0, "n4": 3.0}, "q2": {"gone": 1.0, "n5": -1.0}, "q3": {}}
    q = spark.createDataFrame([(k,) for k in seeds], "query string")
    s = spark.createDataFrame([(k, x, w) for k, v in seeds.items() for x, w in v.items()] + [("q1", None, 1.0), ("q1", "n3", None), ("other", "n1", 1.0)], "query string, node string, weight double")
    n, e = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame([*edges, (None, "n1")], "src string, dst string")
    w = walks.personal_walks(q, n, e, s, tolerance=1e-9)
    got = {(r["query"], r["node"]): r["rank"] for r in w.ranks(q.crossJoin(n)).collect()}
    top = {r["query"]: r["highest"] for r in w.highest().collect()}
    for k, v in seeds.items():
        want = power(nodes, edges, v)
        assert all(abs(got[k, x] - want[x]) < 1e-7 for x in nodes)
        assert abs(top[k] - max(want.values())) < 1e-7
    assert w.near.where("query = 'q3' or query = 'q2'").isEmpty()


def test_ranks_without_seeds_are_uniform_starts(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    none = spark.createDataFrame([("gone", 1.0), ("a", 0.0), ("b", -2.0)], "node string, weight double")
    got = {r["node"]: r["rank"] for r in discovery.pagerank(nodes, edges, none).collect()}
    want = power(["a", "b", "c"], [("a", "b"), ("b", "c")], {})
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_distances_over_edges_laid_out_by_node(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(130)] + [("n0", f"x{k}") for k in range(300)] + [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "n0"), ("n1", None), (None, "n2")]
    e = spark.createDataFrame(edges, "src string, dst string")
    laid = discovery.laid_out(e)
    around = {}
    for a, b in edges:
        if a is not None and b is not None:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    assert sorted(map(tuple, laid.collect())) == sorted((a, b) for a, bs in around.items() for b in bs)
    spans = sorted(map(tuple, laid.groupBy(F.input_file_name()).agg(F.min(F.struct("src", "dst")).alias("low"), F.max(F.struct("src", "dst")).alias("high")).select("low", "high").collect()))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    want, wave, d = {}, {"c0", "n7"}, 0
    while wave:
        want |= dict.fromkeys(wave, d)
        wave, d = {y for x in wave for y in around.get(x, ()) if y not in want}, d + 1
    seeds = spark.createDataFrame([("c0",), ("n7",), (None,)], "node string")
    nodes = spark.createDataFrame([(x,) for x in [*around, "alone"]], "node string")
    got = {r["node"]: r["distance"] for r in discovery.distances(nodes, e, seeds).collect()}
    assert got == {x: want.get(x) for x in [*around, "alone"]}
