"""Cost-balanced sequence packing.

A document is the ids a ``tokenizers`` file gives for its text, then an end id. Each partition is
packed in blocks of about ``BLOCK_TOKENS`` tokens without any shuffle: a document longer than a
sequence is cut into full windows; the rest are pieces with an estimated cost of ``linear * n +
quadratic * n * n``, taken in descending order, each to the sequence of lowest cost whose
remaining capacity holds it. A piece that fits nowhere is cut to fill the roomiest sequence of
lowest cost, and its rest is packed next. A block opens as many full sequences as its tokens
fill; what is left over fills sequences whose sizes are falling powers of two, so none is padded.

Every input row is packed once: nulls and empty texts are the end id alone, repeated ids are
packed as rows of their own, an empty table gives no pieces. Sequence ids hold the partition's
number and are unique; the assignment depends on how rows lie in partitions, its padding does not.
"""

from __future__ import annotations

import json
import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracewell.llm.common import bound_batches, worker_tool

#: Tokens that are packed together, at least one document.
BLOCK_TOKENS = 1 << 20
#: Bytes of text that are encoded together, at least one Arrow batch.
GROUP_BYTES = 8 << 20
#: Runs of letters or marks, and other words, that one call of the library gets.
CALL_RUNS, CALL_WORDS = 200, 2000
MARKS = string.punctuation
# Latin letters whose lower case is one Latin letter (that of U+0130 ends in a combining mark).
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and c.lower() < "\u0250")
PLAIN = f"^(?P<letters>[{LETTERS}]*)(?P<marks>[{re.escape(MARKS)}]*)$"


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive runs of ids, given where each ends, without a copy of the ids."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _flat(runs: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array that ``take`` has made, and where each run ends."""
    _, offsets, data = runs.buffers()
    ends = np.frombuffer(offsets, np.int64, len(runs) + 1)[1:] // 4
    return np.frombuffer(data or b"", "<u4", int(ends[-1]) if len(ends) else 0), ends


class WordEncoder:
    """Ids of whole texts from a library tokenizer whose words are independent.

    The tokenizer drops white space, so texts are cut at spaces and line feeds, and every distinct
    word of a column is encoded once. It lowers letters, and splits a run of marks off a run of
    letters: of words that are Latin letters with marks behind them, both runs are looked up apart,
    the letters in lower case. Distinct runs go through the library's model many at a time; as the
    last token of each ends in the model's suffix, their ids can be told apart. Any other word goes to
    the library whole. Nothing is kept from one column to the next.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_str(source)
        self._library.no_padding()
        self._library.no_truncation()
        self._runs = Tokenizer(self._library.model)
        self._runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        model = json.loads(source)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        if not suffix:
            raise ValueError("a model that marks the end of a word is needed")
        self._last = np.zeros(max(vocab.values()) + 1, bool)
        self._last[[i for s, i in vocab.items() if s.endswith(suffix)]] = True

    def _encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs, one after another, and the number of each."""
        ids = [np.zeros(0, "<u4")]
        for at in range(0, len(runs), CALL_RUNS):
            joined = " ".join(runs[at : at + CALL_RUNS].to_pylist())
            ids.append(np.array(self._runs.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(ids)
        counts = np.zeros(len(runs), np.int64)
        # a wrong number of ends raises
        counts[pc.binary_length(runs).to_numpy() > 0] = np.diff(np.flatnonzero(self._last[ids]) + 1, prepend=0)
        return ids, counts

    def _encode_whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, one after another, and the number of each."""
        ids, counts = [np.zeros(0, "<u4")], []
        for at in range(0, len(words), CALL_WORDS):
            found = [e.ids for e in self._library.encode_batch_fast(words[at : at + CALL_WORDS].to_pylist(), add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
            counts += map(len, found)
        return np.concatenate(ids), np.array(counts, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each text end; null is empty."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = cut.values.dictionary_encode()
        parts = pc.extract_regex(words.dictionary, PLAIN)
        other = parts.is_null()
        letters, marks = (pc.fill_null(p, "") for p in parts.flatten())
        runs = pa.concat_arrays([pc.utf8_lower(letters), marks]).dictionary_encode()
        encoded = self._encode_runs(runs.dictionary), self._encode_whole(words.dictionary.filter(other))
        ids, counts = map(np.concatenate, zip(*encoded))
        table = _binary(ids, np.cumsum(counts))
        # each word is two runs; one that went whole stands behind the runs and has no marks
        pairs = runs.indices.to_numpy().reshape(2, -1).T.copy()
        pairs[other.to_numpy(zero_copy_only=False), 0] = np.arange(len(runs.dictionary), len(counts))
        ids, ends = _flat(table.take(pa.array(pairs.ravel())))
        ids, ends = _flat(_binary(ids, ends[1::2]).take(words.indices))
        return ids, np.append(0, ends)[cut.offsets.to_numpy()[1:]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return _binary(*self.encode(pa.array(texts, pa.string()))).to_pylist()


def sequence_sizes(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then falling powers of two for what is left."""
    left = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; all sequences come out full."""
    sizes = sequence_sizes(sum(lengths), capacity)
    room = np.array(sizes, np.int64)
    cost = np.zeros(len(sizes))
    fill = np.zeros(len(sizes), np.int64)
    out = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(fill[seq])))
        fill[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    whole, rest = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            put(doc, start, capacity, whole)
            whole += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    room, cost, fill = room[whole:], cost[whole:], fill[whole:]
    shift = len(out)
    for n, doc, start in rest:
        while n:
            fits = room >= min(n, int(room.max()))
            seq = int(np.where(fits, cost, np.inf).argmin())
            part = min(n, int(room[seq]))
            put(doc, start, part, seq)
            start, n = start + part, n - part
    return out[:shift] + [(d, s, n, q + whole, o) for d, s, n, q, o in out[shift:]]


def _grouped(batches):
    """Lists of batches of about ``GROUP_BYTES`` of text."""
    group, size = [], 0
    for batch in batches:
        n = batch.column(1).nbytes
        if group and size + n > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(batch)
        size += n
    if group:
        yield group


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: document, start, length, ``ids`` (little-endian 32-bit), the document's
    tokens, sequence and offset in it."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encode = worker_tool(WordEncoder, shared.value).encode
        base, made = TaskContext.get().partitionId() << 32, 0

        def packed(names: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            pieces = np.array(assign(lengths.tolist(), capacity), np.int64)
            # in the order of documents the pieces follow each other in the ids
            doc, start, length, seq, offset = pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))].T
            out = [
                names.take(pa.array(doc)), pa.array(start), pa.array(length), _binary(ids, np.cumsum(length)).cast(pa.binary()),
                pa.array(lengths[doc]), pa.array(seq + base + made), pa.array(offset),
            ]
            made += int(seq.max()) + 1
            return pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        held = None
        for group in _grouped(batches):
            names, texts = (pa.concat_arrays([b.column(c) for b in group]) for c in (0, 1))
            ids, ends = encode(texts)
            ids, lengths = np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1
            if held:
                names, lengths, ids = pa.concat_arrays([held[0], names]), np.append(held[1], lengths), np.append(held[2], ids)
            ends, at, done = np.cumsum(lengths), 0, 0
            while (to := int(np.searchsorted(ends, done + BLOCK_TOKENS)) + 1) <= len(ends):
                yield packed(names[at:to], lengths[at:to], ids[done : ends[to - 1]])
                at, done = to, int(ends[to - 1])
            held = (names[at:], lengths[at:], ids[done:].copy()) if at < len(ends) else None
        if held:
            yield packed(*held)

    kind = docs.schema[id_col].dataType.simpleString()
    columns = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
