"""Words of whole texts as numpy arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 63, _STEP, np.uint64)]))
    return _powers


def span_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty byte spans of ``buf`` that begin at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _BYTE[buf[within + np.repeat(starts, lengths)]] * _power(int(lengths.max()))[within]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _STEP)


@dataclass
class Words:
    """Words of some texts: the joined lower-cased bytes, and for each word its start, length, text and hash."""

    raw: np.ndarray
    buf: np.ndarray
    text_start: np.ndarray
    text_bytes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.owner, minlength=len(self.text_bytes))


def words_of(texts: list[bytes]) -> Words:
    """Maximal runs of bytes other than space and 9 to 13, with A-Z lower-cased."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text_start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)[: len(texts)]
    buf = _LOWER[raw]
    space = _SPACE[buf]
    edge = np.diff(np.concatenate([[1], space.view(np.int8)]))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    owner = np.searchsorted(text_start, start, "right") - 1
    return Words(raw, buf, text_start, size, start, stop - start, owner, span_hashes(buf, start, stop - start))


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the place of the first."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]
