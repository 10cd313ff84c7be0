"""Candidates assembled from spans, against a plain assembler, and their restoration."""

import hashlib
import random

from pyspark.sql import functions as F

from tracewell.operators import mission

SPAN = "struct<start:long,stop:long,kind:string,path:string,sha:string,`from`:long,to:long>"
MISSIONS = f"mission long, raw binary, assessment string, spans array<{SPAN}>"


def digest(b):
    return hashlib.sha256(b).hexdigest()


def plain(raw, assessment, spans, artifacts):
    """The candidate of a mission, piece by piece."""
    if raw is None:
        return None
    spans = sorted(spans or [], key=lambda s: s[:2])
    ends = [0] + [s[1] for s in spans]
    if any(not e <= s[0] < s[1] <= len(raw) for s, e in zip(spans, ends)):
        return raw
    gone = [s for s in spans if s[2] in ("REFERENCE_CANONICAL", "DROP_DUPLICATE")]
    out, at = b"", 0
    for s in spans:
        start, stop, kind, path, sha, lo, hi = s
        out += raw[at:start]
        piece = raw[start:stop]
        shown = piece
        if assessment == "NON_SENSITIVE" and kind == "REFERENCE_CANONICAL":
            content = artifacts.get((path, sha))
            if content is not None and digest(content) == sha and 0 <= lo < hi <= len(content) and content[lo:hi] == piece:
                shown = min(piece, (mission.MARKER % (hi, path, sha, lo)).encode(), key=len)
        if assessment == "NON_SENSITIVE" and kind == "DROP_DUPLICATE" and None not in (lo, hi):
            if 0 <= lo < hi <= start and raw[lo:hi] == piece and not any(lo < g[1] and g[0] < hi for g in gone):
                shown = b""
        out += shown
        at = stop
    return out + raw[at:]


def some_missions(seed, n):
    rng = random.Random(seed)
    artifacts = {}
    for k in range(6):
        content = bytes(rng.choice(b"abc\xc3\x00\xff\n") for _ in range(rng.choice((0, 50, 600))))
        artifacts[f"docs/{k}", digest(content)] = content
    keys = list(artifacts)
    rows = []
    for m in range(n):
        raw, spans = b"", []
        for _ in range(rng.randrange(8)):
            kind = rng.choice((None, "INLINE_CRITICAL", "DELTA", "REFERENCE_CANONICAL", "DROP_DUPLICATE", "DROP_DUPLICATE"))
            path = sha = lo = hi = None
            piece = bytes(rng.choice(b"xy\xe2") for _ in range(rng.randrange(1, 30)))
            if kind == "REFERENCE_CANONICAL":
                path, sha = rng.choice(keys)
                content = artifacts[path, sha]
                lo = rng.randrange(len(content) // 4 + 1)
                hi = rng.choice((len(content), lo + 10))
                piece = content[lo:hi] if rng.random() < 0.8 else piece
                path = rng.choice((path, path, path, "../" + path, None))
                sha = rng.choice((sha, sha, sha, "0" * 64))
            if kind == "DROP_DUPLICATE" and raw:
                lo = rng.randrange(len(raw))
                hi = min(len(raw), lo + rng.randrange(1, 20))
                piece = raw[lo:hi] if rng.random() < 0.9 else piece
            if piece and kind:
                spans.append((len(raw), len(raw) + len(piece), kind, path, sha, lo, hi))
            raw += piece
        rng.shuffle(spans)
        if rng.random() < 0.05 and spans:
            spans.append((spans[0][0], spans[0][1] + 1000, "DELTA", None, None, None, None))
        rows.append((m, raw, rng.choice(("NON_SENSITIVE",) * 6 + ("SENSITIVE", None)), spans))
    return rows, artifacts


def test_candidates_equal_a_plain_assembler_and_restore(spark):
    rows, artifacts = some_missions(1, 700)
    rows += [(1000, None, "NON_SENSITIVE", []), (1001, b"", "NON_SENSITIVE", []), (1002, b"text", "NON_SENSITIVE", None)]
    missions = spark.createDataFrame(rows, MISSIONS).repartition(3)
    held = spark.createDataFrame([(p, s, c) for (p, s), c in artifacts.items()] * 2 + [("docs/0", "0" * 64, b"wrong"), (None, None, None)], "path string, sha string, content binary")
    c = mission.assemble(missions, held)
    got = {r["mission"]: r for r in c.collect()}
    assert {m: None if r["candidate"] is None else bytes(r["candidate"]) for m, r in got.items()} == {m: plain(raw, a, s, artifacts) for m, raw, a, s in rows}
    assert sum(bool(r["recipe"]) for r in got.values()) > 100 and any(g["kind"] == "REFERENCE_CANONICAL" for r in got.values() for g in r["recipe"])
    back = {r["mission"]: (r["outcome"], r["restored"]) for r in mission.restore(c, held).collect()}
    assert back == {m: ("NO_CANDIDATE", None) if raw is None else ("RESTORED", bytearray(raw)) for m, raw, _, _ in rows}
    sizes = {r["mission"]: r["candidate_bytes"] for r in mission.account_spans(missions, held).collect()}
    assert sizes == {m: None if raw is None else len(plain(raw, a, s, artifacts)) for m, raw, a, s in rows}


def test_what_is_spoilt_is_not_restored(spark):
    text = b"0123456789" * 30
    sha = digest(text)
    spans = [(300, 310, "DROP_DUPLICATE", None, None, 0, 10), (310, 610, "REFERENCE_CANONICAL", "docs/a", sha, 0, 300)]
    missions = spark.createDataFrame([(1, text + b"0123456789" + text, "NON_SENSITIVE", spans)], MISSIONS)
    held = spark.createDataFrame([("docs/a", sha, text)], "path string, sha string, content binary")
    c = mission.assemble(missions, held)
    marker = (mission.MARKER % (300, "docs/a", sha, 0)).encode()
    assert bytes(c.first()["candidate"]) == text + marker
    outcome = lambda c, a: mission.restore(c, a).first()["outcome"]
    assert outcome(c, held) == "RESTORED"
    assert outcome(c, held.where("false")) == "MISSING_ARTIFACT"
    assert outcome(c, held.withColumn("content", F.lit(b"spoilt"))) == "MISSING_ARTIFACT"
    put = lambda b: c.withColumn("candidate", F.lit(bytearray(b)))
    assert outcome(put(text + marker[:-1] + b"x"), held) == "MARKER_MISMATCH"
    assert outcome(put(text + marker + b"x"), held) == "LENGTH_MISMATCH"
    assert outcome(put(b"x" + text[1:] + marker), held) == "DIGEST_MISMATCH"
    assert mission.restore(c.limit(0), held).collect() == [] and mission.assemble(missions.limit(0), held).collect() == []


def test_candidates_are_assembled_once(spark):
    from tracewell.plans import corpora

    plan = corpora.mission_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bearer" not in plan
