"""Budgeted maps against a plain loop."""

import random

from pyspark.sql import functions as F

from tracewell.functions.maps import budgeted_map

FILES = "k int, files array<struct<path:string,signatures:array<string>>>, budget int"


def plain(candidates, budget):
    """Files with the signatures that fit: (text, files, cut). A file whose signatures were cut may be followed by a smaller one."""
    out, size, files, cut = [], 0, 0, False
    for path, signatures in candidates:
        lines = [f"{path}:\n", *(f"  {s}\n" for s in signatures)]
        sizes = [len(x.encode()) for x in lines]
        if size + sizes[0] > budget:
            return "".join(out), files, True
        keep, total = 0, 0
        while keep < len(lines) and size + total + sizes[keep] <= budget:
            total += sizes[keep]
            keep += 1
        cut |= keep < len(lines)
        out += lines[:keep]
        size += total
        files += 1
    return "".join(out), files, cut


def maps(spark, rows):
    df = spark.createDataFrame(rows, FILES).select("k", budgeted_map(F.col("files"), F.col("budget")).alias("m"))
    return {r["k"]: r["m"] for r in df.collect()}


def test_budgeted_map_may_go_on_after_a_cut(spark):
    m = maps(spark, [(0, [("a.py", ["f()", "g" * 50]), ("b", [])], 20)])[0]
    assert (m["text"], m["files"], m["cut"], m["candidates"], m["tokens_estimate"]) == ("a.py:\n  f()\nb:\n", 2, True, 2, 4)


def test_maps_equal_a_plain_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé語") for _ in range(rng.randrange(n)))
    rows = [(k, [(word(8), [word(12) for _ in range(rng.randrange(6))]) for _ in range(rng.randrange(8))], rng.choice((0, 1, 2, 5, 20, 60, 200, 10_000))) for k in range(300)]
    got = maps(spark, rows)
    for k, files, budget in rows:
        text, n, cut = plain(files, budget)
        m = got[k]
        assert (m["text"], m["files"], m["cut"], m["n_bytes"], m["candidates"], m["tokens_estimate"]) == (text, n, cut, len(text.encode()), len(files), -(-len(text.encode()) // 4))
    assert sum(m["cut"] for m in got.values()) > 50


def test_nulls_and_many_files(spark):
    many = [(str(k), ["s"] * 50) for k in range(3000)]
    got = maps(spark, [(0, None, 10), (1, [None, (None, None), ("a", [None])], 100), (2, [("a", [])], -5), (3, many, 500), (4, [("a", ["s"] * 5000)], 90)])
    assert (got[0]["text"], got[0]["files"], got[0]["candidates"], got[0]["cut"]) == ("", 0, 0, False)
    assert (got[1]["text"], got[1]["files"], got[1]["candidates"]) == (":\na:\n  \n", 2, 2)
    assert (got[2]["text"], got[2]["cut"]) == ("", True)
    for k, files, budget in ((3, many, 500), (4, [("a", ["s"] * 5000)], 90)):
        assert (got[k]["text"], got[k]["files"], got[k]["cut"], got[k]["candidates"]) == (*plain(files, budget), len(files))
