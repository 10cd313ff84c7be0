"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram one over lower-cased words and an end token. With c counts of the learned
texts and P1 the unigram probability,

    P(w | h) = (c(h w) + mu(h) P1(w)) / (c(h) + mu(h)),   mu(h) = KAPPA * c(h) ** 0.8

which sums to one. P1 discounts every known word by D = n1 / (n1 + 2 n2) and gives what is freed to
the unknown word. A text starts in the context of the end token.

Neither the counts nor the trie fit one machine, so both are split by hash and texts come to them:

1. Texts become blocks: local vocabularies and token sequences, written to the shared folder.
2. Blocks send their vocabularies to the unigram shards, which sum the counts and answer.
3. Knowing c(w), a block computes the base score and sends its distinct bigrams, with the texts
   they stand in, to the trie shards; a frequent context is split over several shards by its
   successor. A shard builds its trie and looks every bigram up.
4. The shards' sums come back to the blocks and are added up by text.

A shard's trie has two levels, both memory-mapped: contexts, with monotone pointers, and
successors, each with a quantised smoothed probability. A query finds its context, follows the
pointers and searches the successor within them.

Shards and blocks have a fixed size and their number grows with the corpus; nothing is pruned or
sampled. Words are known by 64-bit hashes, contexts in a shard by 40 bits, successors within a part of
a context by 24 bits; a part has at most PART_TOKENS of them on average, so an unseen bigram is taken
for a seen one with a chance below PART_TOKENS / 2^24, 0.4 %. Counts are exact at any size. What is
quantised: the trie's probabilities, in steps of 1/2000 power of ten, and the counts that P1 comes from,
exact up to 64 and within 8 % above (``GRID``). No step depends on the corpus, so sizes behave alike.

Defined results: a null text counts as empty, that is, one end token; ids may be null or repeated,
each row is scored by itself; without learned texts every token is unknown and has P1 = 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, materialize, release_shuffles
from tracewell.llm.eliasfano import EliasFano, mapped
from tracewell.llm.textkernel import chunks, mix, words_of

#: Texts' bytes and rows of a block; keys of a unigram shard and tokens of a trie shard.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 50_000
SHARD_KEYS, SHARD_TOKENS = 2_000_000, 2_000_000
#: Learned tokens in one part of a context; a more frequent context is split by successor.
PART_TOKENS = 1 << 16
KAPPA, POWER = 4.0, 0.8
#: Codes of quantised probabilities for each power of ten.
STEPS = 2000
#: The counts that 8-bit codes stand for; the last is beyond any corpus.
GRID = np.concatenate([np.arange(65), 64 * (3e14 / 64) ** (np.arange(1, 192) / 191)])
#: Bits by which a context's successors are told apart.
NEXT = np.uint64(24)
END = np.uint64(0x6E0E5D0FF00D)


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes, larger ones as 32 bits behind an escape, and 64 bits behind another."""
    counts = counts.astype(np.uint64)
    over = counts[counts >= 255]
    far = over[over >= 0xFFFFFFFF]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.minimum(over, 0xFFFFFFFF).astype("<u4").tobytes() + far.astype("<u8").tobytes()


def from_small(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    over = np.flatnonzero(out == 255)
    out[over] = np.frombuffer(data, "<u4", len(over), n)
    far = over[out[over] == 0xFFFFFFFF]
    out[far] = np.frombuffer(data, "<u8", len(far), n + 4 * len(over))
    return out


def squeezed(data: bytes) -> bytes:
    """Places and codes are small numbers most of the time; fast compression saves a third of them."""
    return zlib.compress(data, 1)


def forty(keys: np.ndarray) -> bytes:
    """The upper 40 bits of each key."""
    return np.ascontiguousarray((keys >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_forty(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def three(values: np.ndarray) -> bytes:
    """The lower 24 bits of each value."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def from_three(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view(np.uint32).ravel()


def code(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities: steps of a power of ten, down to 1e-32."""
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-40)) * STEPS), 65535).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(float) / -STEPS)


def count_code(counts: np.ndarray) -> np.ndarray:
    """The nearest place of GRID; 0 is only for 0."""
    if len(counts) and counts.max() > GRID[-1]:
        raise ValueError(f"a word occurs {counts.max()} times, more than {GRID[-1]:.0f}")
    return np.searchsorted((GRID[1:] + GRID[:-1]) / 2, counts, "left").astype(np.uint8)


def unigram(counts: np.ndarray, total: int, types: int, ones: int, twos: int) -> np.ndarray:
    """P1 of words with these counts; every unknown word gets what the discount frees."""
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    unknown = discount * types / total if total else 1.0
    return np.where(counts > 0, np.maximum(counts - discount, 0) / max(total, 1), unknown)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted keys are dealt out in slices."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def slices(shard: np.ndarray, shards: int):
    edges = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, int(edges[s]), int(edges[s + 1])) for s in range(shards) if edges[s] < edges[s + 1]]


BLOCK = "block long, ids array<long>, held array<boolean>, n_tokens array<long>, tokens binary, vocab binary, n_train int, counts binary"


def _block(number: int, rows: list[tuple]) -> dict:
    """Local vocabulary by falling frequency, and the tokens as places in it; learned texts come first."""
    rows = sorted(rows, key=lambda r: r[1])
    texts = [r[2] for r in rows]
    hashes, lengths = [], []
    for _, part in chunks(texts):
        w = words_of(part)
        own = np.full(len(w.hash) + len(part), END)
        own[np.arange(len(w.hash)) + w.owner] = w.hash
        hashes.append(own)
        lengths.append(w.count + 1)
    tokens, lengths = np.concatenate(hashes), np.concatenate(lengths)
    unique, first, inverse, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((first, -times))  # words seen once are numbered as they come, so their places differ by one
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[inverse]
    n_train = sum(not r[1] for r in rows)
    learned = np.bincount(place[: int(lengths[:n_train].sum())], minlength=len(order))
    over = place >= 65535
    data = squeezed(np.where(over, 65535, place).astype(np.uint16).tobytes() + np.diff(place[over], prepend=0).astype(np.int32).tobytes())
    return {
        "block": number, "ids": [r[0] for r in rows], "held": [r[1] for r in rows], "n_tokens": lengths,
        "tokens": data, "vocab": unique[order].tobytes(), "n_train": n_train, "counts": small(learned),
    }


def _record(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("tokens", pa.binary()), ("vocab", pa.binary()), ("n_train", pa.int32()), ("counts", pa.binary())]
)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the rows (id, held, text) of each partition."""

    def run(batches):
        base, made, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                raw = (t or "").encode()
                rows.append((i, bool(h), raw))
                size += len(raw)
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                    yield _record(_block(base + made, rows), _BLOCK_SCHEMA)
                    made, rows, size = made + 1, [], 0
        if rows:
            yield _record(_block(base + made, rows), _BLOCK_SCHEMA)

    return docs.mapInArrow(run, BLOCK)


def _ask_unigrams(shards: int):
    def run(batches):
        for batch in batches:
            for number, vocab, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                keys = np.frombuffer(vocab, np.uint64)
                order = np.argsort(keys)
                keys, learned = keys[order], from_small(counts, len(order))[order]
                for s, lo, hi in slices(shard_of(keys, shards), shards):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([number], pa.int64()), pa.array([keys[lo:hi].tobytes()], pa.binary()), pa.array([small(learned[lo:hi])], pa.binary())], ["shard", "block", "vocab", "counts"])

    return run


def _answer_unigrams(table: pa.Table) -> pa.Table:
    """Total counts for every block, and once for each shard its tokens, types, ones and twos."""
    keys = [np.frombuffer(k, np.uint64) for k in table["vocab"].to_pylist()]
    counts = [from_small(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    edges = np.cumsum([0, *map(len, keys)])
    n = len(keys)
    once = [[int(v)] + [0] * (n - 1) for v in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]
    return pa.table(
        {"shard": table["shard"], "block": table["block"], "totals": pa.array([small(total[inverse[a:b]]) for a, b in zip(edges, edges[1:])], pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in zip(("n", "v", "n1", "n2"), once)}
    )


ASK = "shard int, block long, ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, n_train int, ctx binary, ctx_count binary, ctx_pairs binary, next binary, next_code binary, texts_of binary, texts binary"
_ASK_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("n_train", pa.int32())]
    + [(c, pa.binary()) for c in ("ctx", "ctx_count", "ctx_pairs", "next", "next_code", "texts_of", "texts")]
)


def _ask_bigrams(shards: int, total: int, types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        answers = right.sort_by("shard")["totals"].to_pylist() if right.num_rows else []
        for b in left.to_pylist():
            vocab = np.frombuffer(b["vocab"], np.uint64)
            order = np.argsort(vocab)
            sizes = np.bincount(shard_of(vocab, b["shards"]), minlength=b["shards"])
            counts = np.empty(len(vocab), np.int64)
            counts[order] = np.concatenate([from_small(a, int(n)) for a, n in zip(answers, sizes[sizes > 0])])
            lengths = np.array(b["n_tokens"], np.int64)
            n_tokens = int(lengths.sum())
            data = zlib.decompress(b["tokens"])
            place = np.frombuffer(data, np.uint16, n_tokens).astype(np.int64)
            over = place == 65535
            place[over] = np.cumsum(np.frombuffer(data, np.int32, int(over.sum()), 2 * n_tokens))
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            base = np.add.reduceat(np.log10(counts + 0.5)[place], first) - lengths * np.log10(total + 0.5 * (types + 1))
            known = np.add.reduceat((counts > 0)[place].astype(np.int64), first)
            rows.append({"shard": int(b["block"] % shards), "block": b["block"], "ids": b["ids"], "held": b["held"], "n_tokens": lengths, "n_known": known, "base": base})

            times_of = count_code(counts)
            text = np.repeat(np.arange(len(lengths)), lengths)
            context = np.empty_like(place)
            context[1:] = place[:-1]
            context[first] = int(np.flatnonzero(vocab == END)[0])
            pair = context * len(vocab) + place
            del context, place, over
            by_pair = np.argsort(pair, kind="stable")
            unique, at, times = np.unique(pair[by_pair], return_index=True, return_counts=True)
            c, w = unique // len(vocab), unique % len(vocab)
            del pair, unique
            parts = np.ceil(counts[c] / PART_TOKENS).astype(np.uint64)
            part = np.where(parts > 1, (vocab[w] >> np.uint64(40)) % np.maximum(parts, np.uint64(1)), np.uint64(0))
            key = mix(vocab[c] + part * np.uint64(0x9E3779B97F4A7C15))
            follow = (vocab[w] & np.uint64(0xFFFFFF)).astype(np.uint32)
            order = np.lexsort((follow, key))
            key, follow, times, at, c, w = key[order], follow[order], times[order], at[order], c[order], w[order]
            stop = np.cumsum(times)
            start = stop - times
            texts = text[by_pair[np.arange(n_tokens) - np.repeat(start, times) + np.repeat(at, times)]].astype(np.uint16)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            pairs = np.diff(np.append(new, len(key)))
            for s, lo, hi in slices(shard_of(key, shards), shards):
                a, z = np.searchsorted(new, [lo, hi])
                rows.append(
                    {
                        "shard": s, "block": b["block"], "n_train": b["n_train"], "ctx": forty(key[new[a:z]]), "ctx_count": small(counts[c[new[a:z]]]), "ctx_pairs": small(pairs[a:z]),
                        "next": three(follow[lo:hi]), "next_code": squeezed(times_of[w[lo:hi]].tobytes()), "texts_of": small(times[lo:hi]), "texts": squeezed(texts[start[lo] : stop[hi - 1]].tobytes()),
                    }
                )
        return pa.Table.from_batches([_record(r, _ASK_SCHEMA) for r in rows], _ASK_SCHEMA)

    return run


class Trie:
    """Bigrams of one shard: a context level with pointers and a successor level with probabilities."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, pair_context: np.ndarray, pair_next: np.ndarray, pair_count: np.ndarray):
        """``contexts`` rise; pairs rise by (place of context, next)."""
        mu = KAPPA * counts.astype(float) ** POWER
        self.contexts = EliasFano(contexts, 1 << 40)
        self.pointers = EliasFano(np.searchsorted(pair_context, np.arange(len(contexts) + 1)), len(pair_next) + 1)
        self.successors = EliasFano(pair_context.astype(np.uint64) << NEXT | pair_next.astype(np.uint64), max(len(contexts), 1) << int(NEXT))
        self.backoff = mapped(code(np.where(counts > 0, mu / np.maximum(counts + mu, 1), 1.0)))
        self.share = mapped(code(pair_count / np.maximum((counts + mu)[pair_context], 1)))

    def probability(self, context: np.ndarray, following: np.ndarray, p1: np.ndarray) -> np.ndarray:
        at = self.contexts.find(context)
        own = np.maximum(at, 0)
        begin, end = (self.pointers.get(own + k).astype(np.int64) for k in (0, 1))
        place = self.successors.find(own.astype(np.uint64) << NEXT | following.astype(np.uint64), begin, end)
        seen = (at >= 0) & (place >= 0)
        share = np.where(seen, value(self.share[np.maximum(place, 0)]), 0.0) if self.successors.n else 0.0
        return share + np.where(at >= 0, value(self.backoff[own]), 1.0) * p1


ANSWER = "block long, ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, places binary, sums binary"
_ANSWER_SCHEMA = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("places", pa.binary()), ("sums", pa.binary())]
)


def _answer_bigrams(p1: bytes):
    """Build the shard's trie, look every bigram up, and add the logarithms up by block and text."""
    p1_of = np.frombuffer(p1)

    def run(table: pa.Table) -> pa.Table:
        out, asked = [], []
        for r in table.to_pylist():
            if r["ctx"] is None:
                out.append(_record(r, _ANSWER_SCHEMA))
                continue
            ctx = from_forty(r["ctx"])
            pairs = from_small(r["ctx_pairs"], len(ctx))
            follow = from_three(r["next"])
            times = from_small(r["texts_of"], len(follow))
            texts = np.frombuffer(zlib.decompress(r["texts"]), np.uint16)
            learned = np.add.reduceat((texts < r["n_train"]).astype(np.int64), np.cumsum(times) - times)
            asked.append((r["block"], ctx, from_small(r["ctx_count"], len(ctx)), pairs, follow, np.frombuffer(zlib.decompress(r["next_code"]), np.uint8), times, texts, learned))
        if asked:
            contexts, place = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
            counts = np.zeros(len(contexts), np.int64)
            counts[place] = np.concatenate([a[2] for a in asked])
            of_pair = np.repeat(place, np.concatenate([a[3] for a in asked]))
            follow = np.concatenate([a[4] for a in asked])
            learned = np.concatenate([a[8] for a in asked])
            key = of_pair.astype(np.uint64) << NEXT | follow.astype(np.uint64)
            known, inverse = np.unique(key, return_inverse=True)
            times = np.bincount(inverse, learned).astype(np.int64)
            known, times = known[times > 0], times[times > 0]
            trie = Trie(contexts, counts, (known >> NEXT).astype(np.int64), known & np.uint64(0xFFFFFF), times)
            for block, ctx, _, pairs, follow, codes, times, texts, _ in asked:
                log = np.log10(np.maximum(trie.probability(np.repeat(ctx, pairs), follow, p1_of[codes]), 1e-300))
                sums = np.bincount(texts, np.repeat(log, times))
                places = np.flatnonzero(sums).astype(np.uint16)
                out.append(_record({"block": block, "places": places.tobytes(), "sums": sums[places].astype(np.float32).tobytes()}, _ANSWER_SCHEMA))
        return pa.Table.from_batches(out, _ANSWER_SCHEMA)

    return run


def _collect(total: int):
    def run(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        head = next(r for r in parts if r["ids"] is not None)
        score = np.zeros(len(head["ids"]))
        for r in sorted((r for r in parts if r["places"] is not None), key=lambda r: (r["places"], r["sums"])):
            score[np.frombuffer(r["places"], np.uint16)] += np.frombuffer(r["sums"], np.float32)
        return pa.table(
            {
                "id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(head["held"], pa.bool_()), "n_tokens": pa.array(head["n_tokens"], pa.int64()), "n_known": pa.array(head["n_known"], pa.int64()),
                "train_tokens": pa.array([total] * len(score), pa.int64()), "base_score": pa.array(head["base"], pa.float64()), "score": pa.array(score),
            }
        )

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``held_out`` is a condition on ``id``; such rows are scored but not learned from.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    held = materialize(blocks(source.select("id", held_out.alias("held"), "text")), "lm-blocks")
    size = held.agg(F.sum(F.octet_length("vocab") / 8), F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    keys, tokens = int(size[0] or 0), int(size[1] or 0)
    shards, tries = max(1, -(-keys // SHARD_KEYS)), max(1, -(-tokens // SHARD_TOKENS))
    answer = materialize(
        held.select("block", "vocab", "counts")
        .mapInArrow(_ask_unigrams(shards), "shard int, block long, vocab binary, counts binary")
        .groupBy("shard")
        .applyInArrow(_answer_unigrams, "shard int, block long, totals binary, n long, v long, n1 long, n2 long"),
        "lm-unigrams",
    )
    release_shuffles(docs.sparkSession)
    total, types, ones, twos = (int(x or 0) for x in answer.agg(F.sum("n"), F.sum("v"), F.sum("n1"), F.sum("n2")).first())
    bigrams = (
        held.drop("counts").withColumn("shards", F.lit(shards))
        .groupBy("block")
        .cogroup(answer.select("shard", "block", "totals").groupBy("block"))
        .applyInArrow(_ask_bigrams(tries, total, types), ASK)
    )
    found = bigrams.groupBy("shard").applyInArrow(_answer_bigrams(unigram(GRID, total, types, ones, twos).tobytes()), ANSWER)
    result = found.groupBy("block").applyInArrow(_collect(total), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("id", id_col)
