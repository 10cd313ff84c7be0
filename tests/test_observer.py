"""Counters of a run and telemetry records of sessions, written out."""

import datetime as dt

import duckdb

from tracewell.operators import feed, observer
from tracewell.plans import feeds

CALLS = "session_id string, call_index long, ts timestamp, episode_id long, tool_family string, target_path string, n_bytes long, exit_code long, decision string, avoided_bytes long, grouped string, grouped_avoided long, orientation string, applied boolean"
T = dt.datetime(2024, 1, 1)


def call(session="s", family="FILE_READ", path="a.py", n=100, exit_code=None, decision=None, avoided=None, grouped=None, spared=None, orientation=None, applied=False, episode=1):
    return (session, 1, T, episode, family, path, n, exit_code, decision, avoided, grouped, spared, orientation, applied)


ROWS = [
    call(decision="FIRST_READ"), call(decision="HISTORICAL_IDENTICAL", avoided=40), call(decision="HISTORICAL_IDENTICAL", avoided=30, applied=True), call(path="../b", decision="NOT_ECONOMIC", episode=2), call(path=None, decision="SOURCE_UNKNOWN", applied=None),
    call(family="SEARCH", grouped="APPLICABLE", spared=7), call(family="SEARCH", grouped="APPLICABLE", spared=9, applied=True), call(family="SEARCH", grouped="REJECTED", exit_code=1), call(family="NEW", n=None, orientation="PRODUCED"), call(session="t", family=None, orientation="FAILED", n=0), call(session=None),
]


def test_actual_and_shadow_apart(spark):
    got = observer.lab_counters(spark.createDataFrame(ROWS, CALLS)).first().asDict()
    assert got == {
        "events_seen": 11, "discovery_queries": 2, "orientations_produced": 1, "discovery_failures": 1, "grouped_evaluated": 3, "grouped_eligible": 2, "grouped_no_gain": 0, "grouped_rejected": 1, "grouped_transformed": 1, "grouped_raw": 2,
        "read_evaluations": 5, "reference_candidates": 2, "raw_reads": 4, "failures_kept_raw": 1, "actual_bytes": 39, "actual_grouped_bytes": 9, "shadow_bytes": 47, "shadow_read_bytes": 40, "shadow_grouped_bytes": 7,
    }
    none = observer.lab_counters(spark.createDataFrame([], CALLS)).first()
    assert len(none) == 19 and set(none) == {0}


def test_counters_fill_on_the_way(spark, tmp_path):
    df = spark.createDataFrame(ROWS, CALLS).repartition(3)
    same, seen = observer.observed(df, "lab")
    same.write.parquet(f"{tmp_path}/out")
    assert seen.get == observer.lab_counters(df).first().asDict()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(ROWS)


def test_records_hold_every_rule(spark):
    r = observer.session_records(spark.createDataFrame(ROWS, CALLS).repartition(3), "owner/name", "a" * 40, "b" * 64)
    lines = r.select(feed.serialize(r).alias("value"))
    back = feed.parse(lines)
    got = {x["record"]["session_id_hash"]: x for x in back.select("error", "record", feed.violations(back["record"]).alias("errors")).collect()}
    assert len(got) == 2 and all(x["error"] is None and x["errors"] == [] for x in got.values())
    s = max((x["record"] for x in got.values()), key=lambda x: x["tool_calls"])
    assert (s["tool_calls"], s["tool_output_bytes"], s["file_read_events"], s["first_reads"], s["repeated_reads"], s["identical_reread_events"], s["reference_candidates"], s["reference_bytes_avoided"], s["turns"]) == (9, 800, 5, 1, 3, 3, 2, 70, 2)
    assert s["family_bytes"] == {"FILE_READ": 500, "SEARCH": 300} and s["waste_counts"] == {"REEXPOSURE_WASTE_CANDIDATE": 2, "DISCOVERY_WASTE_CANDIDATE": 1, "REPRESENTATION_WASTE_CANDIDATE": 2}
    assert sorted((p["path"] or "", p["read_events"], p["bytes"]) for p in s["paths"]) == [("", 1, 100), ("a.py", 3, 300)]
    assert s["token_measurements"]["input_tokens"]["quality"] == "UNAVAILABLE" and s["start_time"] == "2024-01-01T00:00:00.000000Z"


def test_session_feed_matches_sql_without_reads_or_graded_searches(spark, tmp_path):
    """Counts of verdicts are null, as the SQL's are, where a session has nothing to judge; other counts are 0."""
    con = duckdb.connect()
    views, clicks, other = [("view", 4), ("view", 4), ("view", 21)], [("click", 3), ("click", 6)], [("signup", 2), ("purchase", 8), ("error", 5)]
    sessions = [views + clicks + other, clicks + other, views + other, other, [*views, ("click", 5)], [("view", 13)], [("click", 7)]]
    events = [(user, kind, k) for user, calls in enumerate(sessions) for kind, k in calls]
    con.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, 0, ?)", [(i, T + dt.timedelta(seconds=i), user, kind, f'{{"k": {k}}}') for i, (user, kind, k) in enumerate(events)])
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got, want = feeds.session_feed(spark, str(tmp_path)), con.sql(feeds.SQL["session_feed"])
    found = sorted(map(tuple, got.collect()))
    assert got.columns == want.columns and found == sorted(want.fetchall())
    assert sum(r[got.columns.index("first_reads")] is None for r in found) == 3 and sum(r[got.columns.index("grouped_applicable")] is None for r in found) == 4
