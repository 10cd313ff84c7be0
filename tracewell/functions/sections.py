"""Selecting sections of Markdown by heading; any doubt gives the whole document.

Fences and headings are a line-by-line state, so this is an Arrow-batched function.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.sources.ship import ship

_HEADING = re.compile(rb" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*\r?\n?")
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})(.*)")


def headings(raw: bytes) -> list[tuple[str, int, int, int]]:
    """(title, level, start, stop) of every section outside fences; an open fence raises."""
    found, at, fence = [], 0, b""
    for line in raw.split(b"\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][:1] == fence[:1] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = b""
        elif mark and mark[1][:1] == b"`" and b"`" in mark[2]:
            raise ValueError("UNCERTAIN_FENCE_SYNTAX")
        elif mark:
            fence = mark[1]
        elif head := _HEADING.fullmatch(line):
            found.append((head[2].decode(), len(head[1]), at))
        at += len(line) + 1
    if fence:
        raise ValueError("UNCLOSED_FENCE")
    stop = lambda k: next((s for _, level, s in found[k + 1 :] if level <= found[k][1]), len(raw))
    return [(title, level, start, stop(k)) for k, (title, level, start) in enumerate(found)]


def merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def select(raw: bytes, wanted: Sequence[str]) -> tuple[bytes, str | None]:
    """The wanted sections in document order, or the whole document and why."""
    if not wanted:
        return raw, "NO_HEADINGS"
    if len(set(wanted)) != len(wanted):
        return raw, "DUPLICATE_SELECTOR"
    try:
        sections = headings(raw)
        raw.decode()
    except UnicodeDecodeError:
        return raw, "INVALID_UTF8"
    except ValueError as e:
        return raw, str(e)
    ranges = []
    for title in wanted:
        own = [(a, b) for t, _, a, b in sections if t == title]
        if len(own) != 1:
            return raw, "AMBIGUOUS_HEADING" if own else "MISSING_HEADING"
        ranges += own
    return b"".join(raw[a:b] for a, b in merged(ranges)), None


#: Rows and bytes of one Arrow batch: a worker holds a batch's documents and what was selected of them several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def select_udf():
    """:func:`select` as a column function; sets the session's bounds on Arrow batches, which hold for documents of any size."""
    ship()
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.pandas_udf("struct<content binary, fallback string>")
    def run(raw: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([select(bytes(r or b""), [str(x) for x in (w if w is not None else [])]) for r, w in zip(raw, wanted)], columns=["content", "fallback"])

    return run
