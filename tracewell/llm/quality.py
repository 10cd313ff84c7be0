"""Quality classifier: a kernel ridge model over document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the whole
text. The normal equations of ridge regression are summed partition by partition and solved on
the driver; their size is that of the features, whatever the corpus. Scores become probabilities
by isotonic regression over a fixed number of score bins.

Labels are learned from every labelled row that is not held out. Scores depend on the text alone.

Defined results: a null text counts as empty and gets the score its statistics give; ids may be
null or repeated and pass through; several labels of one id count with their mean; null labels are
ignored; without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, map_batches, materialize, without_tools
from tracewell.llm.textkernel import chunks, span_hashes, words_of

#: Random features, ridge strength, kernel width in standard deviations, bins of the calibration.
FEATURES = 160
RIDGE = 1e-3
WIDTH = 3.0
BINS = 2048
SEED = 11

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_deviation", "letters", "upper", "digits", "space", "stops",
    "exclamations", "bars", "symbols", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs",
    "short_words", "symbol_ends", "log_lines", "line_length", "repeated_lines", "byte_entropy",
)

_KIND = np.zeros(256, np.int64)  # 0: symbol
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[ord("!")] = 6
_KIND[ord("|")] = 7


def _share_distinct(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct keys, and the most frequent key's count."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(o)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], times)
    return np.bincount(o[at], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(texts)
    w = words_of(texts)
    of_byte = np.repeat(np.arange(n), w.text_bytes + 1)
    real = np.ones(len(w.raw), bool)
    real[w.text_start + w.text_bytes] = False  # the separators
    kinds = np.bincount((of_byte * 8 + _KIND[w.raw])[real], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(w.text_bytes, 1)
    count = w.count
    words = np.maximum(count, 1)
    mean = np.bincount(w.owner, w.length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(w.owner, w.length.astype(float) ** 2, n) / words - mean**2, 0))
    distinct, top = _share_distinct(w.owner, w.hash, n)
    pair = np.flatnonzero(w.owner[1:] == w.owner[:-1])
    pairs = np.maximum(np.bincount(w.owner[pair], minlength=n), 1)
    same = np.bincount(w.owner[pair], w.hash[pair] == w.hash[pair + 1], n) / pairs
    distinct_pairs, _ = _share_distinct(w.owner[pair], w.hash[pair] * np.uint64(3) + w.hash[pair + 1], n)
    last = _KIND[w.raw[w.start + w.length - 1]]
    newline = np.flatnonzero(w.raw == 10)
    begin = np.concatenate([[0], newline[:-1] + 1]).astype(np.int64)
    line = newline - begin
    full = line > 0
    line_owner = of_byte[newline[full]]
    lines = np.bincount(line_owner, minlength=n)
    different, _ = _share_distinct(line_owner, span_hashes(w.buf, begin[full], line[full]), n)
    histogram = np.bincount((of_byte * 256 + w.buf)[real], minlength=256 * n).reshape(n, 256) / size[:, None]
    entropy = -np.sum(np.where(histogram > 0, histogram * np.log2(np.maximum(histogram, 1e-12)), 0), 1)
    letters = kinds[:, 1] + kinds[:, 2]
    return np.stack(
        [
            np.log1p(w.text_bytes), np.log1p(count), mean, spread, letters / size, kinds[:, 2] / np.maximum(letters, 1), kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size,
            kinds[:, 6] / size, kinds[:, 7] / size, kinds[:, 0] / size, distinct / words, top / words, same, distinct_pairs / pairs,
            np.bincount(w.owner, w.length <= 2, n) / words, np.bincount(w.owner, (last == 0) | (last == 6) | (last == 7), n) / words,
            np.log1p(lines), np.bincount(line_owner, line[full], n) / np.maximum(lines, 1) / size, 1 - different / np.maximum(lines, 1), entropy,
        ],
        1,
    ).astype(np.float32)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id`` and ``stats``."""
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        without_tools()
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        rows = [statistics(part) for _, part in chunks(raw)]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.float32)
        offsets = np.arange(len(raw) + 1, dtype=np.int32) * len(STATISTICS)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, stats array<float>")


@dataclass
class Model:
    """Everything a score needs; its size is fixed by the parameters above."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        x = np.clip((stats - self.mean) / self.deviation, -5, 5)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ (rng.standard_normal((stats.shape[1], FEATURES)) / WIDTH) + rng.uniform(0, 2 * np.pi, FEATURES))
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _stack(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def pool_adjacent(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic means: neighbouring bins are pooled while they fall."""
    held: list[list[float]] = []
    for t, w in zip(total, weight):
        held.append([t, w, 1])
        while len(held) > 1 and held[-2][0] * held[-1][1] >= held[-1][0] * held[-2][1]:
            t2, w2, n2 = held.pop()
            held[-1] = [held[-1][0] + t2, held[-1][1] + w2, held[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for t, w, n in held]) if held else np.zeros(0)


def fit(train: DataFrame) -> Model:
    """``train`` has ``stats`` and ``label``. Three small aggregates come to the driver."""
    n = len(STATISTICS)
    cell = [F.element_at("stats", k + 1).cast("double") for k in range(n)]
    row = train.agg(F.count("*"), *[F.avg(c) for c in cell], *[F.stddev_pop(c) for c in cell]).first()
    if not row[0]:
        return Model(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    model = Model(np.array(row[1 : n + 1]), np.maximum(np.array(row[n + 1 :]), 1e-6), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_stack(batch.column(0)))
            y = np.array(batch.column(1).to_numpy(zero_copy_only=False), float)
            total += z.T @ np.concatenate([z, y[:, None]], 1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, j, v in train.select("stats", "label").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    gram = total[:, :-1] + np.diag(np.append(np.full(FEATURES, RIDGE * row[0]), 0))
    model.weights = np.linalg.solve(gram, total[:, -1])

    def raw_scores(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(model.raw(_stack(batch.column(0)))), batch.column(1)], ["raw", "label"])

    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) * (BINS / 2)))).cast("int")
    scored = map_batches(train.select("stats", "label"), raw_scores, "raw double, label double")
    bins = sorted(scored.groupBy(bin_of.alias("bin")).agg(F.avg("raw"), F.sum("label"), F.count("*")).collect())
    model.edges = np.array([b[1] for b in bins])
    model.levels = pool_adjacent(np.array([b[2] for b in bins]), np.array([b[3] for b in bins], float))
    return model


def labelled(stats: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """``stats`` and ``label`` of the rows that may teach."""
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[label_id].alias("id")).agg(F.avg(labels[label_col].cast("double")).alias("label"))
    return stats.where(~held_out).join(known, "id").select("stats", "label")


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its quality; the model is part of the function, its size is fixed."""
    bound_batches(spark)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        without_tools()
        parts = [model.score(statistics(part).astype(float)) for _, part in chunks([(t or "").encode() for t in texts])]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``.

    ``held_out`` is a condition on ``id``; such rows teach nothing. The statistics are written once
    and read for fitting and for scoring.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(materialize(labelled(stats, labels, held_out, label_col, id_col), "quality-train"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_stack(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = stats.schema["id"].dataType.simpleString()
    scored = map_batches(stats, run, f"id {kind}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", "predicted")
