"""What part of a source a read shows: its name, and its exact bytes. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def view_id(view: Column, start: Column, stop: Column, raw: Column) -> Column:
    """One name for each contract; open ends are spelled out, and unknown ones go by a digest of their text."""
    bound = lambda c, default: F.coalesce(c.cast("string"), F.lit(default))
    return (
        F.when(view == "FULL_FILE", "FULL_FILE")
        .when(view == "TAIL", F.concat(F.lit("TAIL:"), start.cast("string")))
        .when(view == "LINE_RANGE", F.concat(F.lit("LINES:"), bound(start, "1"), F.lit("-"), bound(stop, "EOF")))
        .when(view == "BYTE_RANGE", F.concat(F.lit("BYTES:"), bound(start, "0"), F.lit("-"), bound(stop, "EOF")))
        .otherwise(F.concat(F.when(view == "OTHER", "OTHER:").otherwise("UNKNOWN:"), F.substring(F.sha2(F.coalesce(raw, F.lit("")), 256), 1, 12)))
    )


def view_text(text: Column, view: Column, start: Column, stop: Column) -> Column:
    """The lines or bytes of a view, ends of lines included; other views show everything.

    Bounds beyond the text show what there is. Byte bounds must not cut a character.
    """
    lines = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"), F.lit(0))
    n = F.size(lines).cast("long")
    within = lambda c, lo: F.greatest(F.least(c, n), F.lit(lo)).cast("long")
    part = lambda a, b: F.array_join(F.slice(lines, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
    data = text.cast("binary")
    first = F.coalesce(start, F.lit(0))
    last = F.coalesce(stop, F.octet_length(data).cast("long"))
    return (
        F.when(view == "LINE_RANGE", part(within(F.coalesce(start, F.lit(1)) - 1, 0), within(F.coalesce(stop, n), 0)))
        .when(view == "TAIL", part(n - within(start, 0), n))
        .when(view == "BYTE_RANGE", F.substring(data, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).cast("string"))
        .otherwise(text)
    )


def live_proof(held: Column, current: Column) -> Column:
    """What a comparison of a recorded digest with a live view's digest proves; a missing side proves nothing."""
    return F.when(held.isNull() | current.isNull(), "UNPROVEN").when(held == current, "VIEW_EQUAL").otherwise("SOURCE_CHANGED")
