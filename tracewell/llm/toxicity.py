"""Toxicity classifier: subword bags under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (over UTF-8 bytes, with edge marks) hashed into
``BUCKETS_BITS`` bits of embeddings; any ``WINDOW`` words in a row are a window, the average of its
words. A text of fewer words is one window whose missing words count as zero. Embeddings and softmax
start at small random values and are trained together, so a misspelling that was never seen shares
the vectors of the n-grams it keeps.

A label covers a whole text, so the windows' logits are pooled by a soft maximum, the logarithm of
their mean exponential. While all logits are small this is the mean over the text, and every n-gram
that tells the classes apart is learned; as they grow, the windows that hold the evidence take over.
The mean also keeps a long text's many windows from adding up.

Pooled logits become probabilities by a logistic fit to texts that took no part in the training:
two halves of the sample score each other.

Fitting uses a bounded sample of labelled rows of all lengths: up to ``SAMPLE`` of each class, in the
order of a hash of the id, as far as ``SAMPLE_BYTES`` of text go. Scoring covers every whole text.

Defined results: a null or wordless text has a pooled logit of 0; ids may be null or
repeated and pass through; an id with several labels is toxic if any label is; null labels are
ignored; without both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.bpe import _groups, _Parts
from tracewell.llm.common import bound_batches, without_gc, worker_tool
from tracewell.llm.textkernel import mix

BUCKETS_BITS = 20
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 6
WINDOW = 2
#: Rows and bytes of text of each class that are learned from.
SAMPLE, SAMPLE_BYTES = 1200, 6_000_000
EPOCHS, DECAY = 100, 1e-3
#: Steps of the embeddings, the softmax and the bias; what a window's average is multiplied by.
RATES, SCALE = (0.1, 0.1, 0.4), 8.0
#: Damps the steps of n-grams whose gradients are small beside the largest.
FLOOR = 0.5
#: N-grams of fewer sampled texts keep no embedding.
LEAST_TEXTS = 4
#: Weight of all clean texts against all toxic ones when scores become probabilities.
CLEAN_WEIGHT = 3.0
_WORD = re.compile(r"\w+")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram, by word."""
    marked = [b"<" + w.encode() + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes up to the word's end
    value, owners, buckets = np.zeros(len(data), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        value = value * np.uint64(1099511628211) + np.pad(data[n - 1 :], (0, min(n - 1, len(data)))) + np.uint64(1)
        if n >= SHORTEST:
            at = np.flatnonzero(left >= n)
            owners.append(word[at])
            buckets.append((mix(value[at] + np.uint64(n << 56)) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


@dataclass
class Model:
    """Subword embeddings and the softmax over them; columns are clean and toxic."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    #: What a text's pooled logit is multiplied by.
    scale: float = 1.0

    def word_weights(self) -> np.ndarray:
        """Per bucket: what it adds to the toxic logit, less the clean one."""
        return self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def window_sums(weight: np.ndarray) -> np.ndarray:
    """Sum of WINDOW neighbours from each place on; the last ones are incomplete."""
    total = weight.copy()
    for k in range(1, WINDOW):
        total[:-k] += weight[k:]
    return total


class Windows:
    """Places of the words of some texts, the windows that start at them, and how texts own windows.

    Every text with a word has WINDOW places at least; the spare ones hold the word ``blank``.
    """

    def __init__(self, words: list[np.ndarray], blank: int):
        size = np.array([max(len(w), WINDOW) if len(w) else 0 for w in words], np.int64)
        at = np.cumsum(size) - size
        self.word = np.full(size.sum(), blank, np.int32)
        for k, own in enumerate(words):
            self.word[at[k] : at[k] + len(own)] = own
        self.texts = np.flatnonzero(size)
        self.count = size[self.texts] - WINDOW + 1
        self.first = np.cumsum(self.count) - self.count
        self.start = np.arange(self.count.sum()) + np.repeat((WINDOW - 1) * np.arange(len(self.texts)), self.count)

    def pooled(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text of ``texts`` and each window's share in it, from the weights of places."""
        if not len(self.texts):
            return np.zeros(0), np.zeros(0)
        logit = window_sums(weight)[self.start] * (SCALE / WINDOW)
        top = np.maximum.reduceat(logit, self.first)
        part = np.exp(logit - np.repeat(top, self.count))
        total = np.add.reduceat(part, self.first)
        return top + np.log(total / self.count), part / np.repeat(total, self.count)


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Embeddings and softmax of all texts, calibrated on halves that score each other."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros((1 << BUCKETS_BITS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 2), np.float32), np.array([800.0, 0.0]))
    # dealt out class by class, so that both halves hold both
    half = np.zeros(len(texts), bool)
    for kind in (True, False):
        half[np.flatnonzero(toxic == kind)[::2]] = True
    logit = np.zeros(len(texts))
    for side in (half, ~half):
        weights, _, _ = descend([texts[k] for k in np.flatnonzero(~side)], toxic[~side])
        logit[side] = Scorer(weights, 0.0).pooled([texts[k] for k in np.flatnonzero(side)])
    scale, shift = calibration(logit, toxic)
    _, embeddings, softmax = descend(texts, toxic)
    return Model(embeddings, softmax, np.array([-shift / 2, shift / 2]), scale)


def descend(texts: list[str], toxic: np.ndarray, epochs: int | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full-batch gradient descent with adaptive steps: weights of the buckets, embeddings and softmax.

    The loss is the log loss of the pooled logits, both classes weighing the same. The logits are
    linear in the embeddings, so one coefficient for each n-gram carries the whole gradient.
    """
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    found = [np.fromiter((index.setdefault(w, len(index)) for w in _WORD.findall(t.lower())), np.int32) for t in texts]
    n_words = len(index)
    listed, parts = list(index), [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for lo in range(0, n_words, 20_000):  # a few words at a time: 64-bit work arrays are large
        w, g = subwords(listed[lo : lo + 20_000])
        parts.append(((w + lo).astype(np.int32), g.astype(np.int32)))
    gram_word, gram = (np.concatenate(x) for x in zip(*parts))
    del listed, parts, index
    grams_of = np.bincount(gram_word, minlength=n_words)
    edge = np.concatenate([[0], np.cumsum(grams_of)])
    held = np.zeros(1 << BUCKETS_BITS, np.int32)
    for own in found:
        if len(own):
            held[np.unique(np.concatenate([gram[edge[w] : edge[w + 1]] for w in np.unique(own)]))] += 1
    kept = held[gram] >= LEAST_TEXTS
    gram_word, gram = gram_word[kept], gram[kept]
    used, gram = np.unique(gram, return_inverse=True)
    gram, n_used = gram.astype(np.int32), len(used)
    view = Windows(found, n_words)
    label = toxic[view.texts].astype(float)
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    params = [rng.normal(0, 0.1, (n_used, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    epochs = EPOCHS if epochs is None else epochs
    for epoch in range(epochs if n_used else 0):
        e, s, b = params
        apart = s[:, 1] - s[:, 0]
        of_word = np.append(np.bincount(gram_word, (e @ apart)[gram], n_words) / np.maximum(grams_of, 1), 0)
        logit, share = view.pooled(of_word[view.word])
        p = 1 / (1 + np.exp(-np.clip(logit + b[1] - b[0], -30, 30)))
        d = weight * (p - label)
        at = np.zeros(len(view.word))
        at[view.start] = np.repeat(d, view.count) * share * (SCALE / WINDOW)
        at = window_sums(at[::-1])[::-1]
        d_word = np.bincount(view.word, at, n_words + 1)[:n_words] / np.maximum(grams_of, 1)
        d_gram = np.bincount(gram, d_word[gram_word], n_used)
        d_apart = e.T @ d_gram
        slower = 1 - epoch / epochs
        for k, g in enumerate((np.outer(d_gram, apart) + DECAY * e, np.stack([-d_apart, d_apart], 1) + DECAY * s, np.array([-d.sum(), d.sum()]))):
            m, v = state[k]
            m += 0.2 * (g - m)
            v += 0.05 * (g * g - v)
            step = (m / (1 - 0.8 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.95 ** (epoch + 1))) + FLOOR * np.sqrt(v.max()) + 1e-12)
            params[k] = params[k] - RATES[k] * slower * step
    embeddings = np.zeros((1 << BUCKETS_BITS, DIMENSIONS), np.float32)
    embeddings[used] = params[0]
    return (embeddings @ (params[1][:, 1] - params[1][:, 0])).astype(np.float32), embeddings, params[1].astype(np.float32)


def calibration(logit: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn pooled logits into probabilities; clean texts weigh CLEAN_WEIGHT.

    A text without any evidence is at most as toxic as texts are by weight.
    """
    design = np.stack([np.clip(logit, -50, 50), np.ones(len(logit))], 1)
    ridge = np.array([1e-3, 1e-3])
    w = np.where(toxic, 1.0, CLEAN_WEIGHT * toxic.sum() / (~toxic).sum())
    most = -np.log(CLEAN_WEIGHT)
    fit, free = np.array([0.1, most]), np.ones(2, bool)
    for _ in range(2):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
            g = design.T @ (w * (p - toxic)) + ridge * fit
            h = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
            step = np.linalg.solve(h[np.ix_(free, free)], g[free])
            fit[free] -= step / max(1.0, np.abs(step).max() / 2)
        if fit[1] <= most:
            break
        fit[1], free[1] = most, False
    return max(fit[0], 1e-3), fit[1]


class Scorer:
    """Scores of texts under one model; keeps the weights of words in a bounded cache."""

    def __init__(self, weights: np.ndarray, offset: float, scale: float = 1.0):
        def word_weights(words: list[str]) -> list[float]:
            out = []
            for lo in range(0, len(words), 50_000):
                owner, bucket = subwords(words[lo : lo + 50_000])
                n = min(50_000, len(words) - lo)
                out += (np.bincount(owner, weights[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)).tolist()
            return out

        self._known, self._offset, self._scale = _Parts(word_weights), offset, scale

    def pooled(self, texts: list[str]) -> np.ndarray:
        words = [_WORD.findall(t.lower()) for t in texts]
        own: dict[str, int] = {}
        places = [np.fromiter((own.setdefault(w, len(own)) for w in part), np.int32, len(part)) for part in words]
        known = self._known.learn(set(own)).__getitem__
        weight = np.append(np.fromiter(map(known, own), np.float64, len(own)), 0.0)
        view, out = Windows(places, len(own)), np.zeros(len(texts))
        out[view.texts] = view.pooled(weight[view.word])[0]
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        return self.pooled(texts) * self._scale + self._offset

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -700, 700)))


def _scorer(weights: bytes, offset: float, scale: float) -> Scorer:
    return Scorer(np.frombuffer(weights, np.float32), offset, scale)


def sample(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """The bounded training sample, equal texts once: at most SAMPLE ids and SAMPLE_BYTES of each class.

    A text that is longer than all of SAMPLE_BYTES is passed over.
    """
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg((F.max(labels[label_col].cast("double")) > 0.5).alias("toxic"))
    known = known.where(~held_out)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    sizes = texts.groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).where(F.col("size") <= SAMPLE_BYTES)
    chosen = []
    for kind in (True, False):
        # ids are chosen before any text moves
        left = SAMPLE_BYTES
        for r in known.where(F.col("toxic") == kind).join(sizes, "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
            left -= r["size"]
            if left < 0:
                break
            chosen.append((r["id"], kind))
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("toxic", T.BooleanType())]))
    rows = texts.join(F.broadcast(ids), "id").groupBy("text", "toxic").agg(F.min("id").alias("id")).orderBy("id", "toxic").collect()
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], bool)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    return train(*sample(docs, labels, held_out, id_col, text_col, label_col))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its toxicity; the model is broadcast, its size is fixed."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.word_weights().astype(np.float32).tobytes(), model.offset, model.scale))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        tool = worker_tool(_scorer, *shared.value)
        with without_gc():
            parts = [tool(run) for run in _groups([t or "" for t in texts])]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``; ``held_out`` is a condition on ``id``."""
    score = scorer(docs.sparkSession, fit(docs, labels, held_out, id_col, text_col, label_col))
    scored = docs.select(docs[id_col].alias("id"), score(docs[text_col]).alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
