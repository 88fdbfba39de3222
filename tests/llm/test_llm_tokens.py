"""Token ids, packing and token files beside whole-text encoding."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from panelspark.llm import catalog, packing, token_files
from panelspark.llm.tokens import WordEncoder
from panelspark.session import scratch_path

ROWS = [(1, "one two, three. " * 30), (None, "no id"), (None, None), (3, ""), (3, "Again <|endoftext|> x"), (3, "Again <|endoftext|> x"),
        (-5, "é ü\x1cz ́a b"), (9, "word " * 9000)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(catalog.TOKENIZER)


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_words_are_learned_without_arrays(monkeypatch):
    """Words of Latin letters and signs cost a call of the model each; gaps of other words are filled in afterwards."""
    from panelspark.llm import tokens

    encoder = WordEncoder(catalog.TOKENIZER, cache_words=50)
    texts = ["plain Words, and Stra\u00dfe!!", None, "again plain words 12 \u4f60\u597d x1 12", "", "y" * 70 + " 12 " + "z1" * 40 + " " + "z1" * 40]
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    made = []
    real = tokens.np.array
    with monkeypatch.context() as patched:
        patched.setattr(tokens.np, "array", lambda *a, **k: made.append(a) or real(*a, **k))
        assert encoder.encode(texts[:2]) == want[:2] and not made
    for _ in range(3):
        assert encoder.encode(texts) == want
        encoder.forget()
    assert not any(len(w) > 64 for w in encoder.known)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBéÑßżĶ,.'sS. \t\n\r\x0b\x1c\x85\xa0   　́İΣ<|endoftx>9_!!", max_size=40), max_size=4))
def test_words_encode_like_whole_texts(tokenizer, texts):
    encoder = WordEncoder(catalog.TOKENIZER, cache_words=5)
    assert encoder.direct
    assert encoder.encode(texts) == [whole(tokenizer, t) for t in texts]
    assert encoder.encode([*texts, None]) == [whole(tokenizer, t) for t in [*texts, None]]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500)))
def test_patterns_hold_each_length_as_often_as_counted(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = collections.Counter()
    for times, lengths in patterns:
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            held[n] += times
    assert held == collections.Counter(counts)
    assert len(patterns) <= 4 * 64


def test_packing_places_every_id_once(spark, tokenizer):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS sequence_id", "2 AS part")
    got = packing.pack(docs, catalog.TOKENIZER, keep_ids=True).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    want = collections.Counter()
    for key, text in ROWS:
        ids = np.append(np.frombuffer(whole(tokenizer, text), "<u4"), 2).astype("<u4")
        want[(key, len(ids))] += 1
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    for r in got:
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(raw) == 4 * r.length
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length, r.padded_length))
    assert sorted(rows) == list(range(len(rows)))
    for places in rows.values():
        at = 0
        for offset, length, _ in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096 and {p for *_, p in places} == {at if at & (at - 1) == 0 else 4096}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, catalog.TOKENIZER).count() == 0
    folder = scratch_path(spark, "files")
    token_files.write(docs, folder, catalog.TOKENIZER)
    keys = spark.read.parquet(f"{folder}/documents")
    assert token_files.read_keys(keys, folder, catalog.TOKENIZER).count() == 0


def test_token_files_round_trip(spark, tokenizer):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).selectExpr("*", "7 AS nth", "8 AS shard")
    folder = scratch_path(spark, "files")
    token_files.write(docs, folder, catalog.TOKENIZER)
    keys = spark.read.parquet(f"{folder}/documents")
    got = token_files.read_keys(keys, folder, catalog.TOKENIZER, keep_ids=True).collect()
    assert len({(r.doc_id, r.nth) for r in got}) == len(got) == len(ROWS)
    assert sorted(r.nth for r in got if r.doc_id == 3) == [0, 1, 2]
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = collections.Counter((k, whole(tokenizer, t) + b"\x02\0\0\0") for k, t in ROWS)
    assert collections.Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    absent = spark.createDataFrame([(77, 0), (3, 9)], "doc_id long, nth long")
    assert token_files.read_keys(absent, folder, catalog.TOKENIZER).count() == 0


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    levels = token_files.with_ranks(token_files.build_mph(a, b))
    assert sorted(token_files.mph_number(levels, a, b)) == list(range(20_000))
    with pytest.raises(ValueError):
        token_files.build_mph(a[[0, 0]], b[[0, 0]])
