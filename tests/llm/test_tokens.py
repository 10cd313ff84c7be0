"""Tokens, codec and packing against the library on odd texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import bpe, packing

ODD = [
    "", " ", "  a", "a  ", "a\n\n b", "a   b", "\t\n w", "x<|endoftext|>y <|endoftext|>", "a" * 3000, "ab" * 2000 + " \t \n", "日本語 テキスト", "it's we'll 12 3a!?", "\x1c a\x1d\x1fb", "á e‍", "😀😀 x",
    "\xa0 x\xa0y", "A, b. C!", "É. ÉÀ, Straße. İx. ǅ, Σας, ὈΔΥΣΣΕΎΣ.", "ﬁ, ½. ª, ß. K.", "...,", "՘ x", "ŉ, ĳ. ſa.",
]
PATH, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tools():
    with open(PATH, "rb") as f:
        vocab = bpe.Vocabulary(f.read())
    return bpe.TokenCounter(vocab, bpe.whole_tokens(vocab)), bpe.Codec(vocab), vocab


def test_counts_and_ids_equal_the_library(library, tools):
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert tools[0](ODD) == list(map(len, want)) and tools[1].encode(ODD) == want
    assert [tools[1].decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcAB  \n\t.,'12é世<|endoftext|>")), max_size=60))
def test_random_texts(library, tools, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert tools[1].encode([text]) == [want] and tools[0]([text]) == [len(want)] and tools[1].decode(want) == text


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=50))
def test_trees_equal_plain_merging(tools, piece):
    vocab = tools[2]
    plain = bpe.merge_all([vocab.byte_id[b] for b in piece], vocab.merges)
    assert bpe.merge_with_tree([vocab.byte_id[b] for b in piece], vocab.merges) == plain
    assert bpe.MergeTrees(vocab).merge([piece]) == [tuple(plain)]


def test_whole_tokens_are_single(library, tools):
    vocab = tools[2]
    some = sorted(bpe.whole_tokens(vocab))[::97]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_generations_keep_values():
    calls = []
    parts = bpe._Parts(lambda p: calls.extend(p) or [x * 2 for x in p], entries=3)
    for group in ([1, 2], [3, 4], [1, 5], [6, 7, 8, 9]):
        assert all(parts.learn(group)[x] == 2 * x for x in group)
    assert len(parts.young) + len(parts.old) <= 10


def test_word_ids_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    library.no_padding(), library.no_truncation()
    with open(WORDS, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert encoder(ODD) == want == encoder(ODD)


@pytest.fixture(scope="module")
def word_tools():
    library = Tokenizer.from_file(WORDS)
    library.no_padding(), library.no_truncation()
    with open(WORDS, encoding="utf-8") as f:
        return library, packing.WordEncoder(f.read())


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aB z.,!?;:'\n\u0130\u0307\u0301İıſŉǅß½ª<|>12")), st.characters(max_codepoint=0x24F), st.characters(min_codepoint=0x250, max_codepoint=0x3000)), max_size=24))
def test_random_words_equal_the_library(word_tools, text):
    library, encoder = word_tools
    assert encoder([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_every_letter_before_every_mark_equals_the_library(word_tools):
    library, encoder = word_tools
    texts = [f"{a}{chr(c)}{m}" for c in range(33, 0x260) for a in ("", "a", "A") for m in packing.MARKS]
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=40))
def test_packing_fills_every_sequence(lengths):
    pieces = packing.assign(lengths, 64)
    sizes = packing.sequence_sizes(sum(lengths), 64)
    filled, parts = {}, {}
    for doc, start, n, seq, offset in pieces:
        filled.setdefault(seq, []).append((offset, n))
        parts.setdefault(doc, []).append((start, n))
    for runs, total in [*((v, sizes[k]) for k, v in filled.items()), *((v, lengths[k]) for k, v in parts.items())]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
        assert at == total
    assert len(filled) == len(sizes) and len(parts) == len(lengths)


def test_packing_balances_cost():
    pieces = packing.assign([60, 60, 4, 4] * 20, 64)
    assert max(sum(n * n for *_, n, q, _ in [(0, 0, p[2], p[3], 0) for p in pieces] if q == k) for k in range(20)) <= 60 * 60 + 4 * 4


def test_packed_ids(spark):
    texts = [(1, "Hello, world"), (2, None), (3, ""), (None, "x y z"), (3, "again"), (4, "word " * 5000)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    library.no_padding(), library.no_truncation()
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in texts[:5])
    whole = sorted(zlib.crc32(r["ids"]) for r in rows if r["doc_tokens"] == r["length"])
    assert set(want) <= set(whole) and sum(r["length"] for r in rows if r["doc_id"] == 4) == 5001


def test_new_words_encode_like_the_library(word_tools):
    library, encoder = word_tools
    rng = np.random.default_rng(5)
    parts = np.array("an the ing re tion ble en st er ou at ly con ha nd sch ung".split())
    words = ["".join(parts[k]) + m for k, m in zip(rng.integers(0, len(parts), (40_000, 5)), [".", "", ",", "!!"] * 10_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_columns_of_counts_and_codec(spark, monkeypatch):
    """The queries' own columns against the library, on nulls, copies, clashing names and a text of a megabyte without spaces."""
    import hashlib

    from tracewell.llm import queries

    rng = np.random.default_rng(6)
    long = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 350_000).tolist()))
    rows = [(1, "Hello, world"), (2, None), (3, ""), (None, "x y z"), (3, "again"), (4, long), (5, "a  b<|endoftext|>c " * 200), (5, "a  b<|endoftext|>c " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("id", "n_tokens", "ids")})
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    library = Tokenizer.from_file(PATH)
    library.no_padding(), library.no_truncation()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = [(i, t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    got = queries.op5_token_counts(spark, "").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(t.encode()), len(x), len(x) > 512) for i, t, x in ids), key=repr)
    got = queries.op9_bpe_codec(spark, "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, t, x in ids), key=repr)


def test_caches_are_bounded_by_bytes():
    parts = bpe._Parts(lambda missing: [(1,) * 100 for _ in missing], entries=10_000, most=100_000, held=bpe._ids_held)
    for k in range(50):
        known = parts.learn({f"{k} {j}" for j in range(100)} | {f"{k}" + "x" * 100})
        assert all(known[f"{k} {j}"] == (1,) * 100 for j in range(100)) and known[f"{k}" + "x" * 100]
        assert 3600 * (len(parts.young) + len(parts.old)) < 2_000_000
    parts.learn({"one more"})
    assert not any(len(p) > bpe.LONG_PART for p in [*parts.young, *parts.old])


def test_columns_with_nulls_slices_and_nothing(word_tools):
    library, encoder = word_tools
    column = pa.array(["cut off", None, "", "A, b.\nC!!", "12 x", "cut off"])[1:5]
    ids, ends = encoder.encode(column)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
    assert [p.tolist() for p in np.split(ids, ends)[:-1]] == want and ends[-1] == len(ids)
    for empty in (column[:0], pa.array([None, ""], pa.string())):
        assert [len(x) for x in encoder.encode(empty)] == [0, len(empty)]


def test_groups_hold_every_batch_once(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["x" * n])], ["id", "text"]) for k, n in enumerate([5, 5, 900, 1, 1, 1])]
    monkeypatch.setattr(packing, "GROUP_BYTES", 100)
    groups = [[b.column(0)[0].as_py() for b in g] for g in packing._grouped(batches)]
    assert groups == [[0, 1], [2], [3, 4, 5]] and not list(packing._grouped([]))


def test_pieces_of_many_blocks_and_batches(spark):
    texts = [" ".join(["word", "Other,", f"n{k}"] * (k % 300)) for k in range(4500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    parts, filled = {}, {}
    for r in packing.pack_documents(docs, WORDS).collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    library = Tokenizer.from_file(WORDS)
    library.no_padding(), library.no_truncation()
    for k, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert b"".join(ids for _, ids, _ in sorted(parts[k])) == np.array(e.ids + [1], "<u4").tobytes()
        assert {n for *_, n in parts[k]} == {len(e.ids) + 1}
    assert sum(n for runs in filled.values() for _, n in runs) > 2 * packing.BLOCK_TOKENS
    for runs in filled.values():
        ends = np.cumsum([n for _, n in sorted(runs)])
        assert [o for o, _ in sorted(runs)] == [0, *ends[:-1]] and int(ends[-1]).bit_count() == 1
