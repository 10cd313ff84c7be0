"""Classifiers, language model, deduplication, search, archive and media on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import audio, lm, minhash, quality, topk, toxicity, warc
from tracewell.llm.eliasfano import EliasFano
from tracewell.llm.textkernel import words_of

DOCS = "doc_id long, text string"
WORDS = ["river", "stone", "light", "green", "open", "little", "house", "every", "morning", "walk", "under", "bridge"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n)) + "."


def test_words_match_the_pattern():
    import re

    texts = ["Ab  cÉ\n\tx ", "", " ", "one", "a\x0bb\x85c\xa0d"]
    w = words_of([t.encode() for t in texts])
    want = [re.findall(r"[^\x20\x09-\x0d]+", t) for t in texts]
    assert w.count.tolist() == list(map(len, want))
    seen = {}
    for h, word in zip(w.hash.tolist(), [x for t in want for x in t]):
        key = "".join(c.lower() if c.isascii() else c for c in word)
        assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("n", "universe"), [(0, 9), (1, 1), (500, 600), (3000, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    ef = EliasFano(values, universe)
    if n:
        assert (ef.get(np.arange(n)) == values).all()
    asked = np.concatenate([values[:50], rng.integers(0, universe, 50).astype(np.uint64)])
    have = set(values.tolist())
    assert all((k >= 0) == (int(x) in have) and (k < 0 or values[k] == x) for x, k in zip(asked, ef.find(asked).tolist()))


def test_language_model_base_and_distribution(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(0, 40)) if i % 7 else None) for i in range(60)] + [(3, "twice"), (None, "null id")]
    held = F.pmod(F.coalesce(F.col("id"), F.lit(1)), F.lit(5)) == 1
    got = lm.score_texts(spark.createDataFrame(rows, DOCS).repartition(3), held).collect()
    split = lambda t: (t or "").lower().split() + ["\n"]
    out = lambda i: (1 if i is None else i) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(split(t)), sum(c[w] > 0 for w in split(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_scores_equal_an_exact_bigram_model(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(0, 60)) if i % 9 else None) for i in range(120)] + [(200, "word " * 50_000), (4, "the same id again")]
    held = lambda i: i % 5 == 1
    got = lm.score_texts(spark.createDataFrame(rows, DOCS).repartition(3), F.col("id") % 5 == 1).collect()
    split = lambda t: (t or "").lower().split() + ["\n"]
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = split(t)
            one.update(w)
            two.update(zip(["\n", *w], w))
    total, ones, twos = sum(one.values()), sum(v == 1 for v in one.values()), sum(v == 2 for v in one.values())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5

    def log10(h, w):
        p1 = (one[w] - d) / total if one[w] else d * len(one) / total
        mu = lm.KAPPA * one[h] ** lm.POWER
        return math.log10((two[h, w] + mu * p1) / (one[h] + mu)) if one[h] else math.log10(p1)

    exact = lambda t: sum(log10(h, w) for h, w in zip(["\n", *split(t)], split(t)))
    want = sorted((i, round(exact(t), 1), t) for i, t in rows)
    for r, (i, _, t) in zip(sorted(got, key=lambda r: (r["doc_id"], round(r["score"], 1))), want):
        assert r["doc_id"] == i and abs(r["score"] - exact(t)) <= 0.036 * r["n_tokens"]  # a grid step of counts above 64


@pytest.mark.parametrize("total", [10**6, 10**10, 10**13])
def test_counts_and_probabilities_at_every_size(total):
    counts = np.array([0, 1, 2, 64, 254, 255, 2**32 - 2, 2**32 - 1, 2**32, 10**12, 3 * 10**14])
    assert lm.from_small(lm.small(counts), len(counts)).tolist() == counts.tolist()
    p = lm.unigram(counts, total, 1000, 500, 100)
    near = lm.unigram(lm.GRID, total, 1000, 500, 100)[lm.count_code(counts)]
    assert (near[:4] == p[:4]).all() and (np.abs(np.log10(near / p)) < 0.036).all()
    assert (np.abs(lm.value(lm.code(p[1:4])) / p[1:4] - 1) < 1e-3).all()
    with pytest.raises(ValueError):
        lm.count_code(np.array([10**15]))


def test_trie_probabilities_sum_to_one():
    context = np.array([5, 9], np.uint64) << np.uint64(20)
    following = np.array([1, 2, 7, 3], np.uint64)
    trie = lm.Trie(context, np.array([10, 4]), np.array([0, 0, 0, 1]), following, np.array([5, 3, 2, 4]))
    p1 = np.full(8, 1 / 8)
    total = trie.probability(np.repeat(context[:1], 8), np.arange(8), p1).sum()
    assert abs(total - 1) < 0.001
    assert trie.probability(np.array([77], np.uint64), np.array([1]), np.array([0.25]))[0] == 0.25


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = sentence(rng, 90).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "A b"), (901, "a  B"), (902, "a b c"), (903, None), (904, ""), (905, " \n"), (906, sentence(rng, 5000)), (907, rows[0][1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_spanning_links_are_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 100).astype(np.int64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 60, k)])) for k in range(0, 40, 4)]
    links = minhash.spanning_links(np.arange(10), np.arange(10), sets, 85)
    near = [(i, j) for i in range(10) for j in range(i + 1, 10) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert set(links) <= set(near)

    def parts(pairs):
        p = list(range(10))
        for _ in range(10):
            for a, b in pairs:
                p[a] = p[b] = min(p[a], p[b])
        return p

    assert parts(links) == parts(near)


def test_collisions_are_counted_across_parts_only():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 4, (700, minhash.COORDINATES)).astype(np.int32)
    sig[600:] = sig[:100]
    part, size = rng.integers(0, 5, 700), rng.integers(80, 130, 700)
    want = [any(part[i] != part[j] and (sig[i] == sig[j]).sum() >= 30 and 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j]) for j in range(700)) for i in range(700)]
    assert minhash.colliding(sig, size, part, 30, 85).tolist() == want and 0 < sum(want) < 700


def test_texts_that_share_a_passage_but_differ_stay_apart(spark):
    """A hub whose members are alike below the limit, members near others of them, and repeated ids with other texts."""
    rng = random.Random(12)
    common = sentence(rng, 150)
    rows = [(k, common + " " + " ".join(f"own{k}x{n}" for n in range(60))) for k in range(40)]
    rows += [(100 + k, rows[k][1] + " tail") for k in range(0, 40, 3)] + [(200, "x " * 100_000), (None, common)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), 3, 85).collect()}
    assert {k: v for k, v in got.items() if k is not None} == brute_components([r for r in rows if r[0] is not None], 3, 85)


def test_match_threshold_misses_little():
    t = minhash.match_threshold(0.85)
    miss = sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t))
    assert miss <= 1e-7 < miss + math.comb(64, t) * 0.85**t * 0.15 ** (64 - t)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)]
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(21)} == {0} and {got[k] for k in range(100, 140)} == {100}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(70)] + [(200, [0.5] * 6), (201, [0.5] * 6), (300, None), (301, [1.0, None]), (302, [float("nan")]), (303, []), (400, [1e12, -1e12]), (500, [3.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v.where(F.col("id") % 100 == 0), v, 5).collect()}
    ints = {i: [math.floor(1024 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = {}
    for q in (i for i in ints if i % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:5]
        want |= {(q, k + 1): (c, -x) for k, (x, c) in enumerate(s)}
    assert got == want


def test_extreme_components_are_exact_or_raise(spark):
    least = np.full((1, 1), -(2**63))
    assert next(topk.score_block(least, np.array([[3], [5]]))).tolist() == [-3 * 2**63, -5 * 2**63]
    v = lambda rows: topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        v([(0, [1e17]), (1, [1.0])]).collect()
    big = v([(0, [8.9e15, 0.0]), (1, [0.0, 1.0]), (2, [-(2.0**-10), 0.0])])
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(big.where("id = 0"), big, 5).collect()] == [(1, 0), (2, -math.floor(1024 * 8.9e15))]


def test_archive_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx", "x" * 999), (2, "u", "x" * 999), (3, None, big), (5, "u", big), (4, "u", big), (6, "u", None), (7, "u", ""), (None, "u", "y" * 2000), (8, "u", "z" * 3000), (8, "v", "z" * 3000), (2, "w", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    headers, payloads = warc.archive(pages)
    assert payloads.count() == len({r[2] or "" for r in rows})
    got = warc.restore(headers, payloads).select("id", "header", "payload", warc.field(F.col("header"), "WARC-Type").alias("kind"), warc.field(F.col("header"), "WARC-Refers-To").alias("to"), warc.record_bytes(F.col("header"), F.col("payload")).alias("record")).collect()
    assert Counter((r["id"], bytes(r["payload"])) for r in got) == Counter((i, (t or "").encode()) for i, _, t in rows)
    assert {(r["id"], r["to"]) for r in got if r["kind"] == "revisit"} == {(3, "<urn:page:5>"), (4, "<urn:page:5>")}
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
        assert body[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        if r["kind"] == "response":
            assert body[:length].partition(b"\r\n\r\n")[2] == bytes(r["payload"])


def test_a_uri_cannot_forge_a_field(spark):
    ends = ["\u2028", "\u2029", "\x85", "\x0b", "\x0c", "\r", "\n", "\r\n"]
    rows = [(k, f"http://a/{e}WARC-Refers-To: <urn:page:7>{e}WARC-Type: revisit", "x") for k, e in enumerate(ends)]
    headers, payloads = warc.archive(spark.createDataFrame([(*r, "1", 2) for r in rows], "page_id long, url string, html string, id string, header int"))
    h = F.col("header")
    got = warc.restore(headers, payloads).select(warc.field(h, "WARC-Type").alias("kind"), warc.field(h, "WARC-Refers-To").alias("to")).collect()
    assert len(got) == len(rows) and {(r["kind"], r["to"]) for r in got} == {("response", "")}


def test_damaged_payload_fails(spark):
    headers, payloads = warc.archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="damaged"):
        warc.restore(headers, payloads.withColumn("packed", F.lit(zlib.compress(b"other")))).collect()


def test_media_round_trip_and_features():
    rng = np.random.default_rng(1)
    for n in (0, 1, 64, 1000, 70_000):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        padded = audio.pad_payload(data)
        assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(data) and not any(padded[n:])
        assert audio.from_wav(audio.to_wav(padded)) == (padded, audio.RATE_IN)
        mel = audio.log_mel(padded)
        assert (mel == audio.log_mel(padded)).all() and audio.tensors(mel).shape[1:] == (audio.WINDOW, audio.MELS)
    x = rng.normal(size=500).astype(np.float32)
    assert np.allclose(audio.resample(x), audio._resample_by_two(x), atol=1e-5)
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxx")


def plain_log_mel(samples):
    """Loops and textbook formulas in place of slices and strides."""
    x = [(b - 128) / 128 for b in samples]
    half = audio.TAPS // 2
    taps = [np.sinc((k - half) / 2) / 2 * (0.54 - 0.46 * math.cos(2 * math.pi * k / (audio.TAPS - 1))) for k in range(audio.TAPS)]
    taps = [t / sum(taps) for t in taps]
    at = lambda k: x[k] if 0 <= k < len(x) else 0.0
    y = [sum(taps[k] * at(2 * m + k - half) for k in range(audio.TAPS)) for m in range((len(x) + 1) // 2)]
    frames = max(1, 1 + math.ceil((len(y) - audio.FRAME) / audio.HOP))
    y += [0.0] * ((frames - 1) * audio.HOP + audio.FRAME - len(y))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (audio.FRAME - 1)) for k in range(audio.FRAME)]
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edge = [700 * (10 ** ((mel(60) + (mel(4000) - mel(60)) * k / (audio.MELS + 1)) / 2595) - 1) for k in range(audio.MELS + 2)]
    out = []
    for n in range(frames):
        part = y[n * audio.HOP : n * audio.HOP + audio.FRAME]
        mean = sum(part) / len(part)
        bins = np.abs(np.fft.fft([(p - mean) * w * 2 / sum(window) for p, w in zip(part, window)], audio.FFT))[: audio.FFT // 2 + 1] ** 2
        hertz = [k * 8000 / audio.FFT for k in range(len(bins))]
        band = lambda m: sum(b * max(0, min((f - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - f) / (edge[m + 2] - edge[m + 1]))) for b, f in zip(bins, hertz))  # noqa: E731, B023
        out.append([10 * math.log10(band(m) + 1e-8) for m in range(audio.MELS)])
    return np.array(out)


def plain_segments(mel):
    level = [float(np.mean(f, dtype=np.float32)) for f in mel]
    floor = sorted(level)[len(level) // 10]
    found, start = [], None
    for k, v in enumerate(level):
        if start is None and v >= np.float32(floor) + np.float32(audio.OPEN_DB):
            start = k
        elif start is not None and v < np.float32(floor) + np.float32(audio.CLOSE_DB):
            found.append((start, k))
            start = None
    return found + ([(start, len(level))] if start is not None else [])


def test_features_equal_plain_loops():
    rng = np.random.default_rng(5)
    for n in (64, 800, 4000):
        data = rng.integers(32, 127, n, np.uint8).tobytes()
        assert np.abs(audio.log_mel(data) - plain_log_mel(data)).max() < 0.03
    t = np.arange(40_000)
    for gap in (3000, 9000):
        loud = ((t // gap) % 2 * 60 + 0.4) * np.sin(t * 0.2)
        mel = audio.log_mel((128 + loud).astype(np.uint8).tobytes())
        assert audio.segments(mel) == plain_segments(mel) and audio.segments(mel)


def test_stored_tensors_and_odd_rows(spark):
    """Null and repeated ids, a text of a megabyte and clashing columns; stored tensors equal direct ones."""
    rows = [(1, "a b " * 500), (1, "other"), (None, None), (2, ""), (3, "long line " * 120_000)]
    docs = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "doc_id long, text string, media string, n_bytes int, feature string")
    media = audio.store_media(docs)
    stored = audio.audio_features(media).collect()
    assert len(stored) == 5
    for r, m in zip(sorted(stored, key=lambda r: (r["n_bytes"])), sorted(media.collect(), key=lambda r: r["n_bytes"])):
        mel = audio.log_mel(audio.from_wav(bytes(m["media"]))[0])
        assert np.array_equal(np.array([w["tensor"] for w in r["windows"]], np.float32).reshape(-1, audio.WINDOW, audio.MELS), audio.tensors(mel))
        assert [w["start_ms"] for w in r["windows"]] == [k * 800 for k in range(len(r["windows"]))] and r["windows"][-1]["end_ms"] == 25 * len(mel)
    got = {(r["doc_id"], r["n_bytes"]): r for r in audio.media_digests(media).collect()}
    assert set(got) == {(i, len((t or "").encode())) for i, t in rows}
    for i, t in rows:
        padded = audio.pad_payload((t or "").encode())
        r = got[i, len((t or "").encode())]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(audio.to_wav(padded)), hashlib.sha256(audio.to_wav(padded)).hexdigest())


def test_loud_part_is_one_segment():
    t = np.arange(64_000)
    sound = np.where((t > 20_000) & (t < 40_000), 100 * np.sin(t * 0.3), 0.2 * np.sin(t * 0.3))
    found = audio.segments(audio.log_mel((128 + sound).astype(np.uint8).tobytes()))
    assert len(found) == 1 and abs(audio.milliseconds(found[0][0]) - 1250) < 60 and abs(audio.milliseconds(found[0][1]) - 2500) < 60
    assert audio.tensor_array(np.zeros((2, audio.WINDOW, audio.MELS))).type.shape == [audio.WINDOW, audio.MELS]


def test_quality_on_held_out(spark):
    rng = random.Random(3)
    junk = lambda: " ".join(w + rng.choice("$%#*") * 3 for w in sentence(rng, 40).split())
    rows = [(k, junk() if k % 4 == 0 else "\n".join(sentence(rng, 12) for _ in range(4))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 400, 1)] + [(7, None)], "doc_id long, quality int")
    got = quality.score_quality(spark.createDataFrame(rows + [(1000, None), (None, "x")], DOCS), labels, F.coalesce(F.col("id"), F.lit(0)) % 5 == 0).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97


def test_isotonic_levels_rise():
    assert quality.pool_adjacent(np.array([1.0, 0, 2, 1, 5]), np.array([2.0, 2, 2, 2, 5])).tolist() == [0.25, 0.25, 0.75, 0.75, 1.0]


def test_toxicity_on_held_out_and_misspelled(spark):
    rng = random.Random(5)
    bad = ["dreadfool", "dreadfuls", "nastyword", "nastywords"]
    rows, labels = [], []
    for k in range(600):
        words = sentence(rng, 60).split()
        if k % 5 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "so dreadfull indeed")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("id") % 4 == 2).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert got[1002]["predicted"] == 1 and got[1000]["predicted"] == got[1001]["predicted"] == 0


def test_empty_tables_and_clashing_columns(spark):
    from tracewell.llm import bpe, packing
    from tracewell.llm.queries import tokenizer

    wide = "doc_id long, text string, score double, id string, held_out int, ids int, sha string, stats int, label int, block int"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    never = F.lit(False)
    for rows in ([], [(1, "a b c", 0.1, "x", 1, 2, "y", 3, 4, 5), (1, "a b c", 0.1, "x", 1, 2, "y", 3, 4, 5), (None, None, None, None, None, None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, wide)
        for make in (
            lambda: minhash.near_duplicates(docs), lambda: quality.score_quality(docs, labels, never), lambda: lm.score_texts(docs, never), lambda: toxicity.score_toxicity(docs, labels, never),
            lambda: bpe.count_tokens(docs, tokenizer("byte_bpe_50k.json")), lambda: bpe.roundtrip_digests(docs, tokenizer("byte_bpe_50k.json")), lambda: audio.media_digests(audio.store_media(docs)),
            lambda: packing.pack_documents(docs, tokenizer("word_bpe_49k.json")),
        ):
            assert len({(r["doc_id"]) for r in make().collect()}) == len({r[0] for r in rows})
    assert topk.top_k(topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")), topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0
    assert warc.restore(*warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_encoded_media_of_equal_texts_is_equal(spark):
    rows = audio.media_digests(audio.store_media(spark.createDataFrame([(k, "same text " * 30) for k in range(5)] + [(9, "other")], DOCS).repartition(3))).collect()
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] < 9}) == 1
    r = next(r for r in rows if r["doc_id"] == 9)
    assert r["payload_sha256"] == hashlib.sha256(b"other" + bytes(59)).hexdigest() and r["tail_crc32"] == zlib.crc32(b"other" + bytes(59))
