"""What the toxicity classifier learns, which windows it sees, and what length does to a score."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_models import sentence
from tracewell.llm import toxicity


def scored(model, texts):
    return toxicity.Scorer(model.word_weights().astype(np.float32), model.offset, model.scale)(texts)


def rare_words(rng):
    bad = ["".join(rng.choice("bcdfgjkpqvwxz") for _ in range(9)) for _ in range(30)]
    return bad, lambda w: " ".join((words := sentence(rng, 6).split())[:3] + [w] + words[3:])


def test_rare_words_are_learned():
    rng = random.Random(4)
    bad, with_word = rare_words(rng)
    texts = [with_word(bad[k % 30]) for k in range(120)] + [sentence(rng, 6) for _ in range(120)]
    model = toxicity.train(texts, np.arange(240) < 120)
    fresh = scored(model, [with_word(w) for w in bad] + [sentence(rng, 6) for _ in range(60)])
    assert (fresh[:30, None] > fresh[None, 30:]).mean() > 0.95


def test_training_beats_its_start():
    """Without epochs the random start tells nothing; the result comes from the descent."""
    rng = random.Random(14)
    bad, with_word = rare_words(rng)
    texts = [with_word(bad[k % 30]) for k in range(120)] + [sentence(rng, 6) for _ in range(120)]
    toxic = np.arange(240) < 120
    fresh = [with_word(w) for w in bad] + [sentence(rng, 6) for _ in range(60)]
    rate = lambda w: ((s := toxicity.Scorer(w, 0.0).pooled(fresh))[:30, None] > s[None, 30:]).mean()
    assert rate(toxicity.descend(texts, toxic, 0)[0]) < 0.8 < 0.95 < rate(toxicity.descend(texts, toxic)[0])


def test_loss_falls():
    rng = random.Random(9)
    texts, toxic = [sentence(rng, 5) + (" badword" if k % 2 else "") for k in range(12)], np.arange(12) % 2 == 1

    def loss(weights, offset=0.0):
        p = 1 / (1 + np.exp(-(toxicity.Scorer(weights, 0.0).pooled(texts) + offset)))
        return -np.mean(np.log(np.where(toxic, p, 1 - p)))

    start, end = (toxicity.descend(texts, toxic, n)[0] for n in (0, 12))
    assert loss(end) < loss(start) - 0.05


def plain_pooled(text, weights):
    words = [w for w in __import__("re").findall(r"\w+", text.lower())]
    if not words:
        return 0.0

    def word(w):
        owner, bucket = toxicity.subwords([w])
        return float(np.mean(weights[bucket].astype(float))) if len(bucket) else 0.0

    each = [word(w) for w in words] + [0.0] * (toxicity.WINDOW - len(words))
    logit = [sum(each[k : k + toxicity.WINDOW]) * toxicity.SCALE / toxicity.WINDOW for k in range(len(each) - toxicity.WINDOW + 1)]
    return math.log(sum(math.exp(x) for x in logit) / len(logit))


def test_scores_equal_plain_pooling_and_do_not_depend_on_company():
    rng = random.Random(6)
    weights = np.random.default_rng(1).normal(0, 1, 1 << toxicity.BUCKETS_BITS).astype(np.float32)
    texts = ["", "one", "a b", "...", "Ünï cödé tèxt", *(sentence(rng, n) for n in (1, 2, 3, 8, 40, 400))]
    together = toxicity.Scorer(weights, 0.0).pooled(texts)
    assert np.allclose(together, [plain_pooled(t, weights) for t in texts], atol=1e-6)
    assert together.tolist() == [float(toxicity.Scorer(weights, 0.0).pooled([t])[0]) for t in texts]


def test_sample_holds_long_texts_and_long_clean_texts_stay(spark):
    rng = random.Random(7)
    size = lambda k: 1500 if k % 6 == 0 else 30
    texts = [sentence(rng, size(k)) + (" dreadfool" if k % 2 else "") for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)], "doc_id long, toxic int")
    learned, toxic = toxicity.sample(docs, labels, F.lit(False), "doc_id", "text", "toxic")
    assert sorted(learned) == sorted(texts) and toxic.sum() == 120
    model = toxicity.train(learned, toxic)
    assert scored(model, [""])[0] < 0.3
    assert (scored(model, [sentence(rng, 1500) for _ in range(40)]) < 0.3).mean() > 0.9


def test_query_equals_its_operator_and_odd_rows(spark):
    """Repeated ids with other texts, null ids and labels, a text of a megabyte, clashing columns."""
    rng = random.Random(8)
    rows = [(k, sentence(rng, 30) + (" dreadfool" if k % 3 == 0 else "")) for k in range(150)]
    rows += [(3, "another text of id three"), (None, "no id"), (500, "word " * 200_000), (501, None), (502, "")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)] + [(7, None), (9, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.col("id") % 4 == 2).collect()
    model = toxicity.fit(docs, labels, F.col("id") % 4 == 2)
    want = Counter((i, round(float(s), 9)) for (i, _), s in zip(rows, scored(model, [t or "" for _, t in rows])))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == want
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
