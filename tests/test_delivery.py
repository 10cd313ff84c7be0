"""Delivery and expansion on sessions written out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.operators.delivery import deliver, expand, parse_reference
from tracewell.operators.receipts import REFERENCE

READS = "session_id string, call_index long, source string, view string, content string, assessed string, treated boolean, enabled boolean, observed string"
LONG, OTHER = "one line of a file\n" * 20, "another line of it\n" * 20


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def read(at, content=LONG, session="s", source="a.py", view="FULL_FILE", assessed="NON_SENSITIVE", treated=True, enabled=True, observed=None):
    return (session, at, source, view, content, assessed, treated, enabled, observed)


def delivered(spark, rows):
    df = spark.createDataFrame(rows, READS).withColumns({"sha": F.sha2("content", 256), "n_bytes": F.octet_length("content").cast("long")}).repartition(2)
    c = F.col
    return deliver(df, c("source"), c("view"), c("assessed"), c("treated"), c("enabled"), c("observed"))


CASES = {
    "EXACT_REFERENCE": [read(1), read(2)],
    "FIRST_READ": [read(2)],
    "CONTROL": [read(1, treated=False), read(2, treated=False)],
    "SWITCHED_OFF": [read(1), read(2, enabled=False)],
    "NOT_ASSESSED_SAFE": [read(1), read(2, assessed=None)],
    "CROSS_SESSION_FORBIDDEN": [read(1), read(2, observed="t")],
    "SOURCE_CHANGED": [read(1), read(2, OTHER)],
    "NOT_ECONOMIC": [read(1, "tiny"), read(2, "tiny")],
    "MISSING_RECEIPT": [read(1, assessed="UNKNOWN"), read(2)],
    "RECEIPT_MISMATCH": [read(0), read(1, OTHER, assessed=None), read(2, OTHER)],
    "VIEW_UNKNOWN": [read(1), read(2, view=None)],
    "SOURCE_UNKNOWN": [read(1), read(2, source=None)],
}


def test_every_reason(spark):
    rows = [(name, *r[1:]) for name, reads in CASES.items() for r in reads]
    got = {r["session_id"]: (r["reason"], r["delivery"]) for r in delivered(spark, rows).where("call_index = 2").collect()}
    assert got == {name: (name, "READREF" if name == "EXACT_REFERENCE" else "RAW") for name in CASES}


def test_every_emitted_reference_expands_to_equal_bytes(spark):
    rows = [read(k, LONG if k % 4 else OTHER, source=f"{k % 3}.py", session=f"s{k % 2}") for k in range(60)]
    d = delivered(spark, rows)
    refs = d.where("delivery = 'READREF'")
    got = expand(refs, d, "content").collect()
    want = {(r["session_id"], r["call_index"]): r["content"] for r in refs.collect()}
    assert len(got) == len(want) > 10
    assert all(r["outcome"] == "EXPANDED" and r["content"] == want[r["session_id"], r["call_index"]] for r in got)


def test_what_does_not_hold_is_not_expanded(spark):
    d = delivered(spark, [read(1), read(2), read(5, OTHER), read(1, session="t", content=OTHER)])
    good = REFERENCE % (1, sha(LONG), len(LONG))
    asked = [
        ("s", 2, good, "EXPANDED"), ("s", 1, good, "UNKNOWN_RECEIPT"), ("s", 6, good, "METADATA_MISMATCH"), ("t", 2, good, "METADATA_MISMATCH"), ("u", 2, good, "UNKNOWN_RECEIPT"), (None, 2, good, "UNKNOWN_RECEIPT"),
        ("s", 3, REFERENCE % (1, sha(LONG), 7), "LENGTH_MISMATCH"), ("s", 3, REFERENCE % (2, sha(LONG), len(LONG)), "UNKNOWN_RECEIPT"), ("s", 4, good + "\n", "NO_REFERENCE"), ("s", 4, good.replace("0001", "00001"), "NO_REFERENCE"), ("s", 4, None, "NO_REFERENCE"), ("s", 4, "", "NO_REFERENCE"),
    ]
    refs = spark.createDataFrame([a[:3] for a in asked], "session_id string, call_index long, reference string")
    got = sorted(((r["session_id"], r["call_index"], r["reference"], r["outcome"]) for r in expand(refs, d, "content").collect()), key=repr)
    assert got == sorted(asked, key=repr)
    spoilt = d.withColumn("content", F.overlay("content", F.lit("X"), F.lit(1)))
    assert expand(refs.limit(1), spoilt, "content").first()["outcome"] == "DIGEST_MISMATCH"
    assert expand(refs.limit(1), d.withColumn("content", F.lit("corrupt")), "content").first()["outcome"] == "LENGTH_MISMATCH"
    assert expand(refs.limit(0), d, "content").collect() == [] and expand(refs.limit(1), d.limit(0), "content").first()["outcome"] == "UNKNOWN_RECEIPT"


@pytest.mark.parametrize("text", ["[[READ receipt=rcpt-0001 sha256=" + "a" * 63 + " bytes=1]]", "[[READ receipt=rcpt-0001 sha256=" + "A" * 64 + " bytes=1]]", "[[READ receipt=rcpt-0001 sha256=" + "a" * 64 + " bytes=01]]", "[[READ receipt=rcpt-" + "9" * 30 + " sha256=" + "a" * 64 + " bytes=1]]"])
def test_references_have_one_form(spark, text):
    assert spark.range(1).select(parse_reference(F.lit(text)).alias("r")).first()["r"] is None
