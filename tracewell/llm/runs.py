"""Periodic runs of words, by a suffix automaton over each text's words.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words
long, that no neighbouring word extends with that period. Each text's automaton is built word by
word; its states, from the longest to the shortest, then merge the ordered sets of the places
where their strings end, the smaller into the larger. A place that enters a set meets its two
neighbours of the other set there. Both end the state's longest string, and nothing longer in common, so a distance d
not above the state's length seeds a square whose stretch begins exactly where that string does
first. Seeds with equal begin and distance are one run; the farthest of them reaches its end, as
the last two periods of a run are always neighbours in the set in which they meet.

Words that cannot be in a run are cut away before: a run holds each of its words ``exponent`` times
and each of its neighbouring pairs ``exponent - 1`` times. What is left between cuts is counted
again until nothing changes. Prose leaves next to nothing for an automaton.

Defined results: null and empty texts have no words and no runs; a text is worked on whole, in memory
that is linear in its words; equal texts give equal runs; ids pass through, null or repeated;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import bound_batches, map_batches, without_gc, without_tools

#: Places in one list of an ordered set; longer lists are halved.
_PIECE = 1024


class Places:
    """An ordered set of places: short sorted lists behind one another."""

    def __init__(self, place: int):
        self.pieces = [[place]]
        self.firsts = [place]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, place: int) -> tuple[int, int]:
        """The neighbours below and above; -1 where there is none."""
        k = max(bisect_left(self.firsts, place) - 1, 0)
        piece = self.pieces[k]
        at = bisect_left(piece, place)
        below = piece[at - 1] if at else -1
        above = piece[at] if at < len(piece) else self.firsts[k + 1] if k + 1 < len(self.firsts) else -1
        piece.insert(at, place)
        self.firsts[k] = piece[0]
        self.size += 1
        if len(piece) > _PIECE:
            half = len(piece) // 2
            self.pieces[k : k + 1] = [piece[:half], piece[half:]]
            self.firsts[k : k + 1] = [piece[0], piece[half]]
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length of the longest string, suffix link and own place (-1 for copies) of each state; state 0 is the empty string."""
    length, link, own, step = [0], [-1], [-1], [{}]
    last = 0
    for place, word in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        own.append(place)
        step.append({})
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                own.append(-1)
                step.append(step[to].copy())
                link.append(link[to])
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return length, link, own


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """Begin, distance and last place of every stretch that a pair of neighbouring ends seeds."""
    length, link, own = automaton(words)
    ends: list[Places | None] = [None] * len(length)  # sets without a state's own place

    def merged(large: Places, small: Places | list[int], most: int) -> Iterator[tuple[int, int, int]]:
        before = -1
        for place in small:
            below, above = large.add(place)
            if below != before and place - below <= most:  # neighbours of one set have met further down
                yield below - most + 1, place - below, place
            if above >= 0 and above - place <= most:
                yield place - most + 1, above - place, above
            before = place

    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        held, place, parent = ends[state], own[state], link[state]
        ends[state] = None
        if held is None:
            held = Places(place)
        elif place >= 0:
            yield from merged(held, [place], length[state])
        if parent:
            if ends[parent] is not None:
                small, held = sorted((held, ends[parent]), key=lambda places: places.size)
                yield from merged(held, small, length[parent])
            ends[parent] = held


def _runs_of(words: list[int], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """Runs of a stretch that holds no word cut away: start, length, period."""
    reach: dict[tuple[int, int], int] = {}
    for begin, period, last in squares(words):
        if last > reach.get((begin, period), -1):
            reach[begin, period] = last
    runs, farthest, start = [], -1, -1
    for (begin, period), last in sorted(reach.items()):
        if begin != start:
            start, farthest = begin, -1
        if last > farthest:  # else a smaller period covers the stretch: it is no smallest one
            farthest = last
            if last - begin + 1 >= max(least, exponent * period):
                runs.append((begin, last - begin + 1, period))
    return runs


def _stretches(ids: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Stretches outside of which no word is in a run."""
    n = len(ids)
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    while len(lo):
        part = np.repeat(np.arange(len(lo)), hi - lo)
        place = np.arange(len(part)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        _, at, times = np.unique(part * n + ids[place], return_inverse=True, return_counts=True)
        good = times[at] >= exponent
        same = part[1:] == part[:-1]
        _, pair, pairs = np.unique(at[:-1] * n + ids[place[1:]], return_inverse=True, return_counts=True)
        tied = same & good[1:] & good[:-1] & (pairs[pair] >= exponent - 1)
        edge = np.flatnonzero(~np.concatenate([[False], tied, [False]]))
        begin, size = edge[:-1], np.diff(edge)
        keep = size >= least
        new_lo, new_hi = place[begin[keep]], place[begin[keep]] + size[keep]
        if len(new_lo) == len(lo) and (new_lo == lo).all() and (new_hi == hi).all():
            break
        lo, hi = new_lo, new_hi
    return list(zip(lo.tolist(), hi.tolist()))


def find_runs(words: list[bytes], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start and period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < least:
        return []
    index: dict[bytes, int] = {}
    ids = [index.setdefault(w, len(index)) for w in words]
    found = []
    for lo, hi in _stretches(np.array(ids), exponent, max(least, exponent)):
        found += [(lo + s, n, q) for s, n, q in _runs_of(ids[lo:hi], exponent, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``runs`` (start, length, period; by start and period) and ``collapsed``, the kept words joined by a space."""
    bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        without_tools()
        runs, texts = [], []
        with without_gc():
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()  # bytes split at space and 9 to 13 alone
                found = find_runs(words, exponent, least)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapse(words, found)).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], ["id", "runs", "collapsed"])

    name = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {name}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
