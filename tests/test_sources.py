"""Logs, stores, the line tail, sections, symbols and commands."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import pycode, sections
from tracewell.sources import session_log, store
from tracewell.streaming import tail


def call(i, **payload):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{i:02d}Z", "payload": payload})


def test_session_log_pairs_last_records(spark, tmp_path):
    lines = [
        call(1, type="message", role="user"), call(2, type="function_call", call_id="a", name="sh", input="ls"), "{broken", call(3, type="function_call_output", call_id="b", output="early"),
        call(4, type="function_call", call_id="b", input="x"), call(5, type="message", role="user"), call(6, type="function_call_output", call_id="a", output="one"), call(7, type="function_call_output", call_id="a", output="two"), call(8, type="function_call", call_id="lost"),
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    log = session_log.read_log(spark, str(tmp_path / "s.jsonl"))
    got = {r["call_id"]: (r["output"], r["episode_id"]) for r in session_log.paired_calls(log).collect()}
    assert got == {"a": ("two", 1), "b": ("early", 1)}
    f = session_log.fingerprint(log).first()
    assert f["records"] == 8 and f["types"]["message"] == 2


def test_store_keeps_each_object_once_and_refuses_secrets(spark, tmp_path):
    at = str(tmp_path / "store")
    df = lambda *x: spark.createDataFrame([(bytearray(v),) for v in x], "content binary")
    store.put(df(b"a", b"a", b"password = x"), at)
    store.put(df(b"a", b"b"), at)
    assert sorted(bytes(r["content"]) for r in store.get(spark, at).collect()) == [b"a", b"b"]


def test_tail_waits_for_whole_lines_and_notices_rewinds(tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"one\ntw")
    reader = tail._TailReader({"path": str(path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"bytes": 4} and [x for p in reader.partitions(start, end) for x in reader.read(p)] == [(0, "one")]
    with path.open("ab") as f:
        f.write(b"o\nthree\n")
    new = reader.latestOffset()
    assert [x for p in reader.partitions(end, new) for x in reader.read(p)] == [(4, "two"), (8, "three")]
    path.write_bytes(b"x\n")
    with pytest.raises(ValueError, match="rewound"):
        reader.latestOffset()


def test_tail_bounds_batches_and_partitions(tmp_path):
    path = tmp_path / "log"
    lines = [f"line {k} " + "x" * (k % 40) for k in range(200)]
    path.write_text("\n".join(lines) + "\n")
    reader = tail._TailReader({"path": str(path), "maxBytes": "300"})
    read = lambda r, a, z: [x for p in r.partitions(a, z) for _, x in r.read(p)]
    assert read(reader, {"bytes": 0}, reader.latestOffset()) == lines
    at = {"bytes": 0}
    reader.known, got = 0, []
    while (new := reader.latestOffset()) != at:
        assert new["bytes"] - at["bytes"] <= 300
        got += read(reader, at, new)
        at = new
    assert got == lines
    middle = len("\n".join(lines[:100]).encode()) + 1
    later = tail._TailReader({"path": str(path), "maxBytes": "300"})  # a restart: the offset log says where it stood
    end = later.latestOffset()
    assert read(later, {"bytes": middle}, end) == lines[100:]


def test_tail_resumes_from_its_checkpoint(spark, tmp_path):
    path, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        tail.follow(spark, str(path), maxBytes=64).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return [r["line"] for r in spark.read.parquet(out).orderBy("start").collect()]

    path.write_text("".join(f"first {k}\n" for k in range(30)) + "half")
    assert run() == [f"first {k}" for k in range(30)]
    with path.open("a") as f:
        f.write(" done\nlast\n")
    assert run() == [f"first {k}" for k in range(30)] + ["half done", "last"]


def test_state_outlives_a_restart(spark, tmp_path):
    from tracewell.streaming import stateful

    schema = "session_id string, record_index long, event_id long, is_call boolean, call_id string"
    at, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        stateful.pair_calls(spark.readStream.schema(schema).parquet(at)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(stateful.PAIRS).parquet(out).collect())

    assert run([("s", 1, 1, True, "a"), ("s", 2, 2, False, "b"), ("s", 3, 3, True, "b")]) == []
    assert run([("s", 4, 4, False, "a"), ("s", 5, 5, True, "b"), ("t", 1, 6, False, "b")]) == [("s", "a", 1, 4)]
    assert run([("s", 4, 4, False, "a"), ("s", 6, 7, False, "b"), ("s", 7, 8, False, "b")]) == [("s", "a", 1, 4), ("s", "b", 5, 7)]


def test_racing_writers_publish_one_whole(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tracewell.sources import sinks

    def write(name):
        rows = spark.range(50).select("id", F.lit(name).alias("writer"))
        try:
            sinks.publish_all({"a": rows, "b": rows.limit(3)}, str(tmp_path / "race"))
            return name
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [w for w in pool.map(write, "klmn") if w]
    assert len(won) == 1
    a, b = (sinks.published(spark, str(tmp_path / "race"), part) for part in "ab")
    assert (a.count(), b.count()) == (50, 3) and {r["writer"] for r in a.union(b).select("writer").collect()} == set(won)
    assert len([f for f in (tmp_path / "race").iterdir() if f.name.startswith("_")]) == 1  # losers took their own parts away


def test_a_killed_writer_leaves_nothing_visible(spark, tmp_path):
    from tracewell.sources import sinks

    at = tmp_path / "killed"
    spark.range(5).write.json(str(at / "_0" / "data"))
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(at))
    sinks.publish(spark.range(7), str(at))
    assert sinks.published(spark, str(at)).count() == 7 and (at / "_0" / "data").exists()


def test_stream_ledger_survives_kills(spark, tmp_path):
    from tracewell.sources import sinks

    rows = [(f"s{k % 3}", k, "FIRST" if k % 4 else "CHANGED") for k in range(60)]
    schema = "session string, at long, decision string"
    for part in range(4):
        spark.createDataFrame(rows[15 * part : 15 * part + 15], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = sinks.StreamLedger(str(tmp_path / "ledger"), "session", "at", F.col("decision"))
    died = []

    def dies(batch, number):
        """Once before a batch is published, once after and before the stream notes it."""
        if number == 1 and not died:
            died.append("before")
            raise RuntimeError("killed")
        ledger(batch, number)
        if number == 2 and len(died) == 1:
            died.append("after")
            raise RuntimeError("killed")

    for _ in range(3):
        query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as error:
            assert "killed" in str(error)
    assert died == ["before", "after"]
    every = spark.createDataFrame(rows, schema)
    got = ledger.entries(spark)
    assert sinks.broken_chains(got, "session").isEmpty()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sinks.chained(every, "session", "at", F.col("decision")).collect()))
    assert ledger.manifest(spark).collect() == sinks.manifest(every).collect()


def test_sinks_never_overwrite(spark, tmp_path):
    from tracewell.sources import sinks

    rows = spark.createDataFrame([("s", k, f"p{k}") for k in range(5)] + [("t", 1, "q")], "session string, k long, p string")
    at = str(tmp_path / "ledger")
    sinks.write_ledger(rows, "session", "k", F.col("p"), at)
    with pytest.raises(Exception, match="holds a publication"):
        sinks.write_ledger(rows, "session", "k", F.col("p"), at)
    assert {r["session"]: r["entries"] for r in sinks.resume_head(spark, at, "session").collect()} == {"s": 5, "t": 1}
    forged = sinks.published(spark, at).withColumn("payload", F.lit("x"))
    sinks.publish(forged, str(tmp_path / "forged"))
    with pytest.raises(ValueError, match="broken"):
        sinks.resume_head(spark, str(tmp_path / "forged"), "session")
    with pytest.raises(Exception, match="boom"):
        sinks.publish_all({"a": rows, "b": rows.select(F.raise_error(F.lit("boom")).alias("x"))}, str(tmp_path / "set"))
    assert not any((tmp_path / "set").iterdir()) and not sinks.is_published(spark, str(tmp_path / "set"))
    results = spark.createDataFrame([("secret text", "RAW", "DO_NOT_PERSIST"), ("text", "RAW", "EPHEMERAL")], "content string, disposition string, persistence string")
    sinks.append_metrics(results, str(tmp_path / "m"))
    sinks.append_metrics(results, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).columns == ["disposition", "persistence"] and spark.read.json(str(tmp_path / "m")).count() == 2


def test_worktrees_and_artifacts(spark, tmp_path):
    from tracewell.sources import worktree

    root = tmp_path / "tree"
    for name in ("a.py", "p/b.py", "p/__pycache__/c.py", "d.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"x = '{name}'\n")
    files = worktree.scan(spark, str(root))
    held = {r["path"]: r["sha"] for r in files.collect()}
    assert set(held) == {"a.py", "p/b.py"}
    wanted = spark.createDataFrame([("a.py", 11, held["a.py"]), ("p/b.py", 13, "0" * 64), ("gone.py", 1, "1" * 64)], "path string, n_bytes long, sha string")
    assert {r["path"]: r["recovered"] for r in worktree.recover(files, wanted).collect()} == {"a.py": True, "p/b.py": False, "gone.py": False}
    (tmp_path / "s.jsonl").write_text(call(1, type="message", role="user") + "\n{broken\n\n")
    a = session_log.artifact(spark, str(tmp_path / "s.jsonl")).first()
    assert (a["records"], a["malformed"], a["n_bytes"]) == (1, 1, (tmp_path / "s.jsonl").stat().st_size)


def test_corpus_files_fail_on_their_first_bad_line(spark, tmp_path):
    from tracewell.operators import replay

    good = {"schema_version": 4, "entry_id": "e", "source_data": {"raw_content_b64": "YQ==", "byte_length": 1}, "sensitivity_screening": {"result": "DETECTOR_NO_MATCH", "method": "m"}, "heuristic_suggestion": {"evidence_class": "NOISE", "transform_eligibility": "UNKNOWN", "inline_required_facts": [], "method": "h"}}
    (tmp_path / "c.jsonl").write_text("# remark\n\n" + json.dumps(good) + "\n")
    assert [bytes(r["raw"]) for r in replay.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()] == [b"a"]
    (tmp_path / "bad.jsonl").write_text(json.dumps(good | {"entry_id": ""}) + "\n")
    with pytest.raises(Exception, match="ENTRY_ID"):
        replay.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


MARKDOWN = b"# A\nx\n```\n# not\n```\n## B\ny\n### C\nz\n# D\nw\n"


@pytest.mark.parametrize(
    ("wanted", "content", "why"),
    [(["B"], b"## B\ny\n### C\nz\n", None), (["C", "B"], b"## B\ny\n### C\nz\n", None), (["D", "C"], b"### C\nz\n# D\nw\n", None), (["not"], MARKDOWN, "MISSING_HEADING"), ([], MARKDOWN, "NO_HEADINGS"), (["B", "B"], MARKDOWN, "DUPLICATE_SELECTOR")],
)
def test_sections(wanted, content, why):
    assert sections.select(MARKDOWN, wanted) == (content, why)


def test_sections_fall_back_in_doubt():
    assert sections.select(b"# A\n```\n", ["A"])[1] == "UNCLOSED_FENCE"
    assert sections.select(b"# A\n# A\n", ["A"])[1] == "AMBIGUOUS_HEADING"
    assert sections.select(b"# A\n\xff", ["A"])[1] == "INVALID_UTF8"
    assert sections.select(b"# A\n``` a`b\n", ["A"])[1] == "UNCERTAIN_FENCE_SYNTAX"


def test_symbols_and_imports(spark):
    files = spark.createDataFrame([("p/a.py", "from . import b\nimport p.c as q\nX = 1\nclass K:\n  def m(self):\n    import os\ndef f(): pass\n"), ("p/b.py", ""), ("p/c.py", "def ("), ("p/__init__.py", None)], "path string, text string")
    found = pycode.symbols(files)
    assert {(r["kind"], r["name"]) for r in found.where(F.col("path") == "p/a.py").collect()} == {("IMPORT", "b"), ("IMPORT", "q"), ("CONSTANT", "X"), ("CLASS", "K"), ("METHOD", "K.m"), ("FUNCTION", "f")}
    assert found.where("kind = 'PARSE_ERROR'").count() == 1
    assert {(r["src"], r["dst"]) for r in pycode.import_edges(found, files).collect()} == {("p/a.py", "p/b.py"), ("p/a.py", "p/c.py")}


def test_files_split_many_ways_number_like_one_range(spark, tmp_path):
    import json

    from tracewell.sources.lines import numbered_lines

    kinds = [{"type": "message", "role": "user"}, {"type": "function_call", "call_id": "c{}", "name": "exec", "input": "x"}, {"type": "function_call_output", "call_id": "c{}", "output": "out {}"}, {"type": "message", "role": "tool"}]
    for name in "ab":
        rows = []
        for k in range(200):
            payload = {f: v.replace("{}", str(k // 3)) for f, v in kinds[k % 4 if name == "a" else k * k % 4].items()}
            rows.append("" if k % 17 == 5 else "{broken" if k % 23 == 7 else json.dumps({"timestamp": f"t{(k * 7) % 100:03}", "session": name, "payload": payload}))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    read = lambda: session_log.read_log(spark, str(tmp_path))
    one = sorted(map(str, read().collect())), sorted(map(str, session_log.paired_calls(read()).collect())), sorted(map(str, session_log.fingerprint(read()).collect()))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 50
        many = sorted(map(str, read().collect())), sorted(map(str, session_log.paired_calls(read()).collect())), sorted(map(str, session_log.fingerprint(read()).collect()))
        lines = numbered_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert one == many and len(one[0]) > 300 and len(one[1]) > 20
    assert [r["value"] for r in lines] == (tmp_path / "a.jsonl").read_text(encoding="utf-8").split("\n")[:-1]
    assert [r["line_no"] for r in lines] == list(range(1, 201))


def test_bytes_behind_paths(spark, tmp_path):
    import base64

    from tracewell.operators import replay

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.bin").write_bytes(b"\x00from a file")
    (tmp_path / "outside.bin").write_bytes(b"no")
    data = "struct<raw_content_b64:string,raw_ref_path:string>"
    rows = [(1, (base64.b64encode(b"inline").decode(), None)), (2, (None, "x.bin")), (3, (None, "gone.bin")), (4, (None, "../outside.bin")), (5, (None, None)), (6, (base64.b64encode(b"both").decode(), "x.bin"))]
    entries = spark.createDataFrame(rows, f"k int, source_data {data}")
    got = {r["k"]: r["raw"] and bytes(r["raw"]) for r in replay.with_bytes(entries, replay.stored_bytes(spark, str(tmp_path / "raw"))).collect()}
    assert got == {1: b"inline", 2: b"\x00from a file", 3: None, 4: None, 5: None, 6: None}
