"""BPE (exact ids, round trips) and packing (whole, gapless, little padding)."""

import gc
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdictlake.llm import bpe, common, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(coder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(texts)]


def test_awkward_texts(coder, reference):
    texts = ["", " ", "a  b", "a   b", "x \n y", "foo\n ", "\ttab", "aaaaaaaaaaaa", "½ ²a", "<|endoftext|>", "hi<|endoftext|> x<|endoftext|>", "日本語 😀", "it's we'll", "a\x1cb \x1c", "é ́x", "x" * 5000]
    assert ids_of(coder, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*" \n\tab's½1² .!日\x1c\x85é", "<|endoftext|>"]), max_size=40).map("".join))
def test_same_ids_and_round_trip(text):
    with open(PATH, encoding="utf-8") as f:
        own = _HELD.setdefault("bpe", None) or _HELD.update(bpe=bpe.Bpe(f.read())) or _HELD["bpe"]
    ref = _HELD.get("ref") or _HELD.setdefault("ref", Tokenizer.from_file(PATH))
    (ids,) = ids_of(own, [text])
    assert ids == ref.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False) == text


_HELD: dict = {}


def test_memory_may_start_anew(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    monkeypatch.setattr(coder, "room", {"words": 100, "pieces": 100})
    texts = ["the quick brown fox", "jumps over the lazy dog", "x" * 300_000, "the quick brown fox"]
    watched = gc.isenabled()
    assert ids_of(coder, texts)[0] == ids_of(coder, texts[3:])[0]
    assert not coder.words and not coder.pieces and gc.isenabled() == watched


def test_slices_are_bounded_in_bytes():
    texts = pa.array(["a" * n for n in (5, 5, 30, 1, 1, 1, 1, 1)] + [None, ""])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), texts], names=["id", "text"])
    got = [s.column(0).to_pylist() for s in common.slices(iter([batch, batch.slice(0, 0)]), 1, rows=4, size=10)]
    assert got == [[0, 1], [2], [3, 4, 5, 6], [7, 8, 9]]


def test_round_trip_query_shape(spark, coder):
    docs = spark.createDataFrame([(1, "hello world", "en"), (1, "hello world", "en"), (2, None, None), (None, "", "x"), (3, "a\n  b", "n_tokens")], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, len(ids_of(coder, ["a\n  b"])[0]))]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == r["decoded_sha256"] == empty for r in rows if r["n_tokens"] == 0)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r["text"] for r in back.collect()) == ["", "", "a\n  b", "hello world", "hello world"]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def check_packed(rows, ids_by_doc, sequence=2048):
    used = {}
    for r in rows:
        used.setdefault(r["doc_id"], []).append(r)
    for doc, ids in ids_by_doc.items():
        at = 0
        for r in sorted(used[doc], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and len(part) == r["length"] and r["doc_tokens"] == len(ids)
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= sequence
    return len(by)


def test_packing_is_whole_and_tight(spark, coder):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 1800))) for _ in range(400)] + ["word " * 9000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, PATH).collect()
    ids = {i: x + [1] for i, x in enumerate(ids_of(coder, texts))}
    n = check_packed(rows, ids)
    assert sum(map(len, ids.values())) / (2048 * n) > 0.95


def test_packing_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x"), (None, "y")], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    assert len(rows) == 5 and sum(r["doc_tokens"] for r in rows) == 7
    assert len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows)[0] == 0
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_column_generation_against_the_bound():
    histogram = {3: 40, 5: 31, 7: 22, 10: 17, 16: 4}
    plan = packing.cutting_plan(dict(histogram), 16)
    used = {}
    for p in plan:
        assert sum(c * a for c, a in p.items) <= 16
        for c, a in p.items:
            used[c] = used.get(c, 0) + a * p.count
    assert used == histogram
    bound = -(-sum(c * n for c, n in histogram.items()) // 16)
    assert bound <= sum(p.count for p in plan) <= bound + 2


def test_knapsack_finds_the_best_pattern():
    prices, sizes = np.array([1.0, 2.2, 3.9]), np.array([2, 4, 7])
    best = max(((a + b * 2.2 + c * 3.9), a, b, c) for a in range(6) for b in range(4) for c in range(3) if 2 * a + 4 * b + 7 * c <= 11)
    worth, column = packing.best_pattern(prices, sizes, 11)
    assert worth == pytest.approx(best[0]) and (sizes * column).sum() <= 11
