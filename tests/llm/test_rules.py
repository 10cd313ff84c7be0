"""Quality rules: counts against plain Python, exact binomials, and thresholds against their own rule."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries, rules

DOCS = "doc_id long, text string, lang string"
WORDS = ["river", "Stone", "light", "green", "open", "little", "house", "every", "morning", "walk", "under", "bridge"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if many[w] > 1 for p in range(k, k + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "\n", "#", "😀"]) for _ in range(n))


def test_counts_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(0, 120)), None) for i in range(120)]
    rows += [(500, None, "en"), (501, "", ""), (502, " \n\t\x0b\x0c\r\n", "en"), (None, "a b c d e " * 3, "xx"), (503, "a " * 30, "en"), (504, "same line\nsame line\n same line\n\n\n", "en"), (505, "É\xa0x \x85 " * 9, "fr")]
    rows += [(506, "one two three four five six one two three four five", "en"), (507, " ".join(f"w{k % 4000}" for k in range(9000)), "en"), *rows[:4]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("id", "stratum", "digest", "n_words", "w", "signals", "kept")}).repartition(3)
    got = rules.text_counts(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *plain(t)) for i, t, _ in rows), key=repr)


def test_binomial_tails_are_exact(spark):
    rows = [(x, n) for n in (1, 5, 15, 16, 17, 100, 1000, 5000) for x in sorted({0, 1, n // 500, n // 130, n // 101, n // 100, n // 99, n}) if x <= n]
    got = spark.createDataFrame(rows, "x long, n long").withColumn("p", rules.binomial_tail(F.col("x"), F.col("n"), 0.01)).collect()
    for r in got:
        want = math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(k + 1) - math.lgamma(r["n"] - k + 1) + k * math.log(0.01) + (r["n"] - k) * math.log1p(-0.01)) for k in range(r["x"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9) or (r["x"] >= 0.01 * r["n"] and r["p"] == 1.0)
    large = spark.range(1).select(rules.binomial_tail(F.lit(9_990_000).cast("long"), F.lit(1_000_000_000).cast("long"), 0.01).alias("p")).first()["p"]
    assert large == pytest.approx(7.4e-4, rel=0.02)  # 3.18 deviations below the mean


def labelled(rng, n, noise):
    """Good texts with few symbols; a poor one in five has many."""
    rows, labels = [], []
    for i in range(n):
        poor = i % 5 == 0
        words = [rng.choice(WORDS) + str(rng.randrange(10_000)) + ("%%%" if rng.random() < (0.9 if poor else noise) else "") for _ in range(40)]
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        labels.append((i, int(not poor)))
    return rows, labels


def test_thresholds_keep_their_promise(spark):
    rows, labels = labelled(random.Random(4), 3000, 0.02)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = rules.apply_rules(docs, marks).join(marks.withColumnRenamed("doc_id", "id"), "id").groupBy("stratum", "quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {(r["stratum"], r["quality"]): r["kept"] for r in got}
    assert all(kept[s, 0] < 0.02 for s in ("en", "de")) and all(kept[s, 1] > 0.98 for s in ("en", "de"))


def test_too_few_labels_reject_nothing_and_copies_count_once(spark):
    rows, labels = labelled(random.Random(4), 300, 0.02)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    assert rules.apply_rules(docs, marks).where("kept = base_failed").count() == 0
    good = [r for r in rows if r[0] % 5][:1]
    copies = spark.createDataFrame([(1000 + k, good[0][1], "en") for k in range(3000)], DOCS)  # 3,000 copies are one draw
    marked = marks.union(copies.select("doc_id", F.lit(1)))
    assert rules.apply_rules(docs.union(copies), marked).where("kept = base_failed").count() == 0
    none = marks.limit(0)
    assert rules.apply_rules(docs, none).where("kept = base_failed").count() == 0
    assert rules.apply_rules(docs.limit(0), marks).collect() == []


def test_query_equals_sql_on_noisy_labels(spark, monkeypatch):
    rng = random.Random(9)
    rows, labels = labelled(rng, 2500, 0.03)
    rows += [(None, "no id " * 8, None), (7, rows[3][1], "en"), (9000, None, "fr"), (9001, rows[3][1], "de"), (9002, "", "xx")]
    labels += [(11, 0), (12, None), (None, 1), (9001, 0), (9000, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    monkeypatch.setattr(queries, "table", lambda _s, _d, name: docs if name == "documents" else marks)
    got = queries.op12_quality_rules(spark, "")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", marks.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP12_SQL})").fetchall()
    have = [tuple(r) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert 0 < sum(not r[-1] and not r[-2] for r in have) < len(have)
