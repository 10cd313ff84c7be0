"""Byte-level BPE: counting with a whole-token shortcut, and encoding with a segment tree.

Both operators read a ``tokenizers`` JSON file whose model is byte-level BPE without a
normalizer. The file is read once on the driver and broadcast; its size is that of a
vocabulary, whatever the corpus.

A text is cut at single spaces. If no two white-space characters touch, the pre-tokenizer
always starts a new piece at such a space, so each cut part can be handled alone and its result
kept in a bounded cache; otherwise the whole text goes through the pre-tokenizer at once.

Defined results: a null text counts as empty (0 tokens); ids may be null or repeated and pass
through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewell.llm.common import bound_batches, map_batches, without_gc, worker_tool

# The public pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of one generation of a worker's caches.
CACHE_ENTRIES = 300_000
#: Bytes of a generation before it grows old, and characters of a part that is worth keeping.
CACHE_BYTES = 128 << 20
LONG_PART = 64
_TWO_SPACES = re.compile(r"\s\s")


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte in vocabulary strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return tuple(chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256))


class Vocabulary:
    """Ids, merge ranks and special strings of one tokenizer file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        letters = byte_alphabet()
        value = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(value[c] for c in s) for s, i in ids.items()}
        self.byte_id = [ids[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        self._pattern = regex.compile(PATTERN)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._source = source
        self._library = None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens. Beyond Latin letters the library's own tables decide what is a letter."""
        if text.isascii() or max(text) < "ɐ":
            return self._pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._source.decode()).pre_tokenizer
        return [text[i:j] for i, j in dict.fromkeys(at for _, at in self._library.pre_tokenize_str(text))]

    def sections(self, text: str) -> list[str]:
        """The text around special strings, which stand at odd places."""
        return self._special.split(text) if self._special else [text]


def merge_all(ids: list[int], merges: dict) -> list[int]:
    """Plain BPE: join the lowest-ranked adjacent pair, leftmost first, until none is left."""
    while len(ids) > 1:
        best = min((merges[p] + (i,) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None, key=lambda m: (m[0], m[2]))
        if best is None:
            break
        ids[best[2] : best[2] + 2] = [best[1]]
    return ids


def merge_with_tree(ids: list[int], merges: dict) -> list[int]:
    """BPE over a segment tree whose leaves hold the ranks of adjacent pairs.

    A leaf's key is rank * n + position, so the root's minimum is the leftmost pair of lowest
    rank. A merge rewrites at most three leaves, each in logarithmic time.
    """
    n = len(ids)
    if n < 2:
        return ids
    top = n * (len(merges) + 1)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [top] * (2 * size)
    for i in range(n - 1):
        if (m := merges.get((ids[i], ids[i + 1]))) is not None:
            tree[size + i] = m[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < top:
        i = tree[1] % n
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, top)
        if k < n:
            before[k] = i
            m = merges.get((ids[i], ids[k]))
            put(i, top if m is None else m[0] * n + i)
        else:
            put(i, top)
        if (h := before[i]) >= 0:
            m = merges.get((ids[h], ids[i]))
            put(h, top if m is None else m[0] * n + h)
    return [i for i in ids if i >= 0]


class MergeTrees:
    """The segment trees of many short pieces side by side, one numpy row for each.

    The same steps as :func:`merge_with_tree`: read every root, apply its merge, rewrite the three
    leaves beside it and their ancestors; rows whose root holds no merge drop out. Longer pieces
    are merged one by one.
    """

    LONGEST = 33

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        pairs = np.array([(a << 32 | b, rank, new) for (a, b), (rank, new) in vocab.merges.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self._pair, self._rank = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], 0)
        self._made = np.zeros(len(pairs) + 1, np.int64)
        self._made[pairs[:, 1]] = pairs[:, 2]
        self._byte = np.array(vocab.byte_id, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray, place, none: int) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self._pair, key)
        return np.where((self._pair[at] == key) & (a >= 0) & (b >= 0), self._rank[at] << 6 | place, none)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > self.LONGEST:
                out[k] = tuple(merge_with_tree([self.vocab.byte_id[b] for b in piece], self.vocab.merges))
            else:
                sizes.setdefault(1 << max(len(piece) - 2, 0).bit_length(), []).append(k)
        for size, rows in sizes.items():
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                for k, ids in zip(part, self._same_size([pieces[k] for k in part], size)):
                    out[k] = ids
        return out

    def _same_size(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        n, width, none = len(pieces), size + 1, (len(self.vocab.merges) + 1) << 6
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < length[:, None], self._byte[raw], -1)
        tree = np.full((n, 2 * size), none, np.int64)
        tree[:, size:] = self._ranks(ids[:, :-1], ids[:, 1:], np.arange(size), none)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        row = np.arange(n)
        while True:
            root = tree[row, 1]
            going = root < none
            row, root = row[going], root[going]
            if not len(row):
                break
            i, new = root & 63, self._made[root >> 6]
            j = after[row, i]
            k = after[row, j]
            ids[row, i], ids[row, j], after[row, i] = new, -1, k
            inside = k < length[row]
            before[row[inside], k[inside]] = i[inside]
            right = np.where(inside, ids[row, np.minimum(k, size)], -1)
            h = before[row, i]
            left = np.where(h >= 0, ids[row, h], -1)
            first = np.maximum(h, 0)
            tree[row, size + i] = self._ranks(new, right, i, none)
            tree[row[j < size], size + j[j < size]] = none
            has = h >= 0
            tree[row[has], size + h[has]] = self._ranks(left[has], new[has], h[has], none)
            for leaf in (i, np.minimum(j, size - 1), first):
                node = (size + leaf) >> 1
                while size > 1 and node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


def whole_tokens(vocab: Vocabulary) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as one token.

    A string is in the set if its bytes are valid UTF-8, the pre-tokenizer leaves it whole, and
    merging its bytes by rank ends in the one token. Membership of a pre-token then settles its
    count without merging.
    """
    found = []
    for i, raw in vocab.bytes_of.items():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if i not in vocab.specials.values() and vocab.pieces(text) == [text] and merge_all([vocab.byte_id[b] for b in raw], vocab.merges) == [i]:
            found.append(text)
    return frozenset(found)


class _Parts:
    """What the parts of texts give, in a cache of two generations that entries and bytes bound.

    ``compute`` gets a list of parts that are not known yet, ``held`` tells the bytes that a list of values
    holds. Parts above LONG_PART characters are forgotten at the next call.
    """

    def __init__(self, compute: Callable[[list[str]], list], entries: int = CACHE_ENTRIES, most: int = CACHE_BYTES, held: Callable[[list], int] = lambda values: 0):
        self.compute, self.entries, self.most, self.held = compute, entries, most, held
        self.young: dict = {}
        self.old: dict = {}
        self.bytes = 0
        self.passing: list[str] = []

    def keep(self, parts: list, values: list) -> None:
        self.young.update(zip(parts, values))
        lengths = list(map(len, map(str, parts)))
        if lengths and max(lengths) > LONG_PART:
            self.passing += [p for p, n in zip(parts, lengths) if n > LONG_PART]
            kept = [k for k, n in enumerate(lengths) if n <= LONG_PART]
            lengths, values = [lengths[k] for k in kept], [values[k] for k in kept]
        self.bytes += 150 * len(lengths) + 2 * sum(lengths) + self.held(values)

    def learn(self, parts) -> dict:
        """A mapping that has every one of ``parts``."""
        for p in self.passing:
            del self.young[p]
        self.passing = []
        if len(self.young) + len(parts) > self.entries or self.bytes > self.most:
            self.old, self.young, self.bytes = self.young, {}, 0
        young, old = self.young, self.old
        missing = [p for p in parts if p not in young]
        if old and missing:
            again = [p for p in missing if p in old]
            self.keep(again, [old[p] for p in again])
            missing = [p for p in missing if p not in young]
        if missing:
            self.keep(missing, self.compute(missing))
        return young


def _ids_held(values: list) -> int:
    """About the bytes of tuples of token ids."""
    return 36 * sum(map(len, values))


class _Pieces:
    """Cuts texts into parts, looks the parts up, and has unknown ones worked out together.

    ``merge`` maps a list of pre-tokens to their values, ``add`` joins the values of a part.
    """

    def __init__(self, vocab: Vocabulary, merge: Callable[[list[str]], list], add: Callable, held: Callable[[list], int] = lambda values: 0):
        self.vocab, self.add = vocab, add
        self.known = _Parts(merge, held=held)
        self.rest = _Parts(lambda parts: self.values([" " + p for p in parts]), held=held)

    def values(self, texts: list[str]) -> list:
        pieces = [self.vocab.pieces(t) for t in texts]
        known = self.known.learn(set(chain.from_iterable(pieces)))
        add, get = self.add, known.__getitem__
        return [add(map(get, p)) for p in pieces]

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text the values of its sections, in order; a special string gives its own text."""
        whole, parts, plans = [], set(), []
        for text in texts:
            plan = []
            for k, section in enumerate(self.vocab.sections(text)):
                if k % 2:
                    plan.append(section)
                elif _TWO_SPACES.search(section):
                    plan.append(len(whole))
                    whole.append(section)
                else:
                    first, *others = section.split(" ")
                    plan.append((len(whole), others))
                    whole.append(first)
                    parts.update(others)
            plans.append(plan)
        done = self.values(whole)
        known = self.rest.learn(parts).__getitem__
        add = self.add
        return [[x if isinstance(x, str) else done[x] if isinstance(x, int) else add(chain((done[x[0]],), map(known, x[1]))) for x in plan] for plan in plans]


class TokenCounter:
    """Counts tokens of texts; pre-tokens that are whole tokens are counted without merging."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str]):
        trees = MergeTrees(vocab)

        def merge(pieces: list[str]) -> list[int]:
            rest = [p for p in pieces if p not in whole]
            counts = dict(zip(rest, map(len, trees.merge([p.encode() for p in rest]))))
            return [counts.get(p, 1) for p in pieces]

        self._pieces = _Pieces(vocab, merge, sum)

    def __call__(self, texts: list[str]) -> list[int]:
        return [sum(1 if isinstance(x, str) else x for x in sections) for sections in self._pieces(texts)]


class Codec:
    """Encodes texts to ids and ids back to a text."""

    def __init__(self, vocab: Vocabulary):
        trees = MergeTrees(vocab)
        self.vocab = vocab
        self._pieces = _Pieces(vocab, lambda pieces: trees.merge([p.encode() for p in pieces]), lambda values: tuple(chain.from_iterable(values)), _ids_held)

    def encode(self, texts: list[str]) -> list[list[int]]:
        special = self.vocab.specials
        return [list(chain.from_iterable((special[x],) if isinstance(x, str) else x for x in sections)) for sections in self._pieces(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _groups(texts: list[str], most: int = 2 << 20):
    """Runs of texts of about ``most`` characters, so that one run's ids stay small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache(maxsize=2)
def _vocabulary(source: bytes) -> Vocabulary:
    return Vocabulary(source)


def _counter(source: bytes, whole: frozenset[str]) -> TokenCounter:
    return TokenCounter(Vocabulary(source), whole)


def _codec(source: bytes) -> Codec:
    return Codec(Vocabulary(source))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens and whether they exceed ``limit``."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, "rb") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast((source, whole_tokens(_vocabulary(source))))

    def run(batches):
        count = worker_tool(_counter, *shared.value)
        for batch in batches:
            texts = _texts(batch)
            with without_gc():
                n = [x for run in _groups(texts) for x in count(run)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def encode_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, the token ids of the whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = worker_tool(_codec, shared.value).encode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for run in _groups(_texts(batch)) for x in encode(run)], pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``, special tokens kept. Null ids give an empty text."""
    spark = encoded.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = worker_tool(_codec, shared.value).decode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode from the ids, in one pass; per row the digests of both.

    Holds the ids of a few texts at a time instead of a batch's.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = worker_tool(_codec, shared.value)
        shown = {i: str(i) for i in tool.vocab.bytes_of}
        rows = []
        with without_gc():
            for ids in (ids for run in _groups(_texts(batch)) for ids in tool.encode(run)):
                rows.append((len(ids), hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(tool.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
