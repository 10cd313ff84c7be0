"""Audio features of media columns.

A payload is stored as an 8-bit mono WAV file. Features come from the stored file: polyphase
resampling, overlapped log-mel filterbanks, and hysteresis energy segmentation. The features of a
file are fixed-shape tensors of ``WINDOW`` frames by ``MELS`` bands, each with its time span.

Everything is computed file by file in blocks of a fixed number of frames, so equal payloads give
equal features wherever and beside whatever they are processed. Band energies are rounded to
hundredths of a decibel, which absorbs the last bits that differ between numeric libraries.

Media and tensors are both tables in the shared folder: :func:`store_media` writes the files, what is
read back goes through :func:`audio_features`, and :func:`media_digests` describes what that stored.

Defined results: a null payload counts as empty; an empty one is stored as 64 zero bytes by
:func:`pad_payload`; a file shorter than one frame is padded with silence. Ids may be null or
repeated: every row is worked on by itself and comes out once. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import bound_batches, map_batches, materialize

RATE_IN, UP, DOWN = 16_000, 1, 2
RATE = RATE_IN * UP // DOWN
TAPS = 8 * max(UP, DOWN) + 1
FRAME, HOP, FFT, MELS = 400, 200, 512, 24
#: Frames of one tensor, and of one block of work.
WINDOW = 32
BLOCK = 1024
#: Decibels above the file's floor at which a segment opens, and below which it closes.
OPEN_DB, CLOSE_DB = 12.0, 6.0
HEADER = 44


def pad_payload(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """An 8-bit mono PCM file; an odd number of samples gets the format's pad byte."""
    n = len(samples)
    head = b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", n) + samples + bytes(n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM is needed")
        if name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase low-pass taps (phase by tap), the frame's window, and the mel matrix."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(t * cut) * cut * np.hamming(TAPS)
    taps *= UP / taps.sum()
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / RATE)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return taps, np.hanning(FRAME), np.maximum(0, np.minimum(up, down))


def resample(x: np.ndarray) -> np.ndarray:
    """Rational resampling by UP / DOWN: each output sample uses only the taps of its phase."""
    taps, _, _ = _filters()
    n = -(-len(x) * UP // DOWN)
    half = TAPS // 2
    padded = np.concatenate([np.zeros(TAPS, x.dtype), x, np.zeros(TAPS + DOWN, x.dtype)])
    out = np.zeros(n)
    for phase in range(UP):
        m = np.arange(phase, n, UP)
        centre = m * DOWN
        first = (centre + half) % UP
        for offset in np.unique(first):
            own = m[first == offset]
            base = (own * DOWN + half) // UP + TAPS
            for k, tap in enumerate(taps[offset::UP]):
                out[own] += tap * padded[base - k]
    return out


def _resample_by_two(x: np.ndarray) -> np.ndarray:
    """:func:`resample` for halving, with slices in place of index arrays."""
    taps, _, _ = _filters()
    half, n = TAPS // 2, -(-len(x) // 2)
    padded = np.concatenate([np.zeros(half, np.float32), x, np.zeros(half + 2, np.float32)])
    out = np.zeros(n, np.float32)
    for k, tap in enumerate(taps.astype(np.float32)):
        out += tap * padded[k : k + 2 * n : 2]
    return out


def log_mel(samples: bytes) -> np.ndarray:
    """Frames by MELS, in decibels of full scale, rounded to hundredths."""
    _, window, mel = _filters()
    window, mel = window.astype(np.float32), mel.astype(np.float32)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = _resample_by_two(x) if (UP, DOWN) == (1, 2) else resample(x).astype(np.float32)
    frames = max(1, 1 + -(-(len(y) - FRAME) // HOP))
    y = np.pad(y, (0, max(0, (frames - 1) * HOP + FRAME - len(y))))
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((frames, MELS), np.float32)
    for lo in range(0, frames, BLOCK):
        # a last block of another length would let the matrix product round otherwise
        part = np.zeros((BLOCK if frames > BLOCK else frames, FRAME), np.float32)
        part[: len(view[lo : lo + BLOCK])] = view[lo : lo + BLOCK]
        part -= part.mean(1, keepdims=True)
        power = np.abs(np.fft.rfft(part * (2 / window.sum() * window), FFT)) ** 2
        out[lo : lo + BLOCK] = (10 * np.log10(power @ mel + 1e-8))[: min(BLOCK, frames - lo)]
    return np.round(out, 2)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame intervals of sound: opened OPEN_DB above the floor, held until below CLOSE_DB."""
    level = mel.mean(1)
    floor = np.sort(level)[len(level) // 10]
    state = np.where(level >= floor + OPEN_DB, 1, np.where(level < floor + CLOSE_DB, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (known >= 0) & (state[np.maximum(known, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensors(mel: np.ndarray) -> np.ndarray:
    """Windows of WINDOW frames; the last is filled with the quietest level."""
    n = -(-len(mel) // WINDOW)
    out = np.full((n * WINDOW, MELS), mel.min(), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, WINDOW, MELS)


def tensor_array(windows: np.ndarray) -> pa.ExtensionArray:
    """The windows as Arrow's fixed-shape tensor type."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(windows, np.float32))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 // RATE


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` of the text and ``media``, the padded text as a WAV file, written and read back."""
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(pad_payload(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col), "media")


FEATURES = "windows array<struct<start_ms:long,end_ms:long,tensor:array<float>>>, segments array<struct<start_ms:long,end_ms:long>>"
_SPAN = [("start_ms", pa.int64()), ("end_ms", pa.int64())]


def _stored(windows: list[np.ndarray]) -> pa.Array:
    """All windows as fixed-shape tensors, in the list form that Spark and Parquet hold."""
    flat = np.concatenate(windows) if windows else np.zeros((0, WINDOW, MELS), np.float32)
    if not len(flat):
        return pa.array([], pa.list_(pa.float32()))
    return tensor_array(flat).storage.cast(pa.list_(pa.float32()))


def audio_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of ``media`` but the files, with ``windows`` (tensors and their time spans) and ``segments``
    (the spans of sound)."""
    bound_batches(media.sparkSession)
    rest = [c for c in media.columns if c != media_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut, spans, counts = [], [], [0]
        starts, ends = [], []
        for blob in batch.column(batch.num_columns - 1).to_pylist():
            mel = log_mel(from_wav(blob)[0] if blob else bytes(64))
            cut.append(tensors(mel))
            n = len(cut[-1])
            counts.append(counts[-1] + n)
            starts += [milliseconds(k * WINDOW) for k in range(n)]
            ends += [milliseconds(min(len(mel), (k + 1) * WINDOW)) for k in range(n)]
            spans.append([{"start_ms": milliseconds(a), "end_ms": milliseconds(b)} for a, b in segments(mel)])
        each = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), _stored(cut)], ["start_ms", "end_ms", "tensor"])
        windows = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], windows, pa.array(spans, pa.list_(pa.struct(_SPAN)))], [*rest, "windows", "segments"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in media.select(rest).schema)
    return map_batches(media.select(*rest, media_col), run, kept + FEATURES)


def feature_texts(features: DataFrame) -> DataFrame:
    """The columns of ``features`` with ``feature``, one line about the tensors and segments, in their place."""
    rest = [c for c in features.columns if c not in ("windows", "segments")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        windows, found = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
        each = windows.flatten()
        tensor = each.field("tensor").flatten().to_numpy(zero_copy_only=False).reshape(-1, WINDOW * MELS)
        ends, edge = each.field("end_ms").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(windows.value_lengths(), np.int64))])
        for k, spans in enumerate(found):
            own = tensor[edge[k] : edge[k + 1]]
            end = int(ends[edge[k + 1] - 1])
            frames = end * RATE // (HOP * 1000)
            mean = own.reshape(-1, MELS)[:frames].mean(dtype=np.float64)
            sound = ",".join(f"{s['start_ms']}-{s['end_ms']}" for s in spans[:3])
            digest = hashlib.sha256(np.round(own * 100).astype("<i4").tobytes() + repr([(s["start_ms"], s["end_ms"]) for s in spans]).encode()).hexdigest()[:32]
            rows.append(f"rate={RATE_IN}->{RATE};tensors={len(own)}x{WINDOW}x{MELS};end_ms={end};mean_db={mean:.2f};segments={len(spans)}[{sound}];digest={digest}")
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, pa.string())], [*rest, "feature"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in features.select(rest).schema)
    return map_batches(features.select(*rest, "windows", "segments"), run, kept + "feature string")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_bytes``, digests of the stored file and its payload, and ``feature``.

    The tensors are written to the shared folder and read back before they are described.
    """
    bound_batches(media.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for blob in batch.column(2).to_pylist():
            payload, _ = from_wav(blob)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest()))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(5)), batch.column(2)], ["id", "n_bytes", *names, "media"])

    kind = media.schema[id_col].dataType.simpleString()
    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary"
    digested = map_batches(media.select(media[id_col].alias("id"), "n_bytes", "media"), run, f"id {kind}, n_bytes long, {columns}")
    return feature_texts(materialize(audio_features(digested), "tensors")).withColumnRenamed("id", id_col)
