"""Packing against the library's ids, and the plan against its own counts."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from viewloom.llm.packing import encode, make_plan, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x1c\x85  'sTdLa1½.,!éΣİ<|endoftext|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_match_library(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode([text], PATH)[0], "<u4").tolist() == want


def test_special_strings():
    for text in ("a<|endoftext|>b", "<|ENDOFTEXT|> x", " <|startoftext|>  "):
        assert np.frombuffer(encode([text], PATH)[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan = make_plan(counts, 64)
    seen = {}
    for length, n in counts.items():
        for s, o in zip(*plan.place(np.full(n, length), np.arange(n)), strict=True):
            seen.setdefault(int(s), []).append((int(o), length))
    for parts in seen.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 64


def test_pack(spark):
    texts = [None, "", "hello world", "word " * 9000, "a b c " * 700, "a b c " * 700, *[f"text {i} " * (i % 90 + 1) for i in range(300)]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = pack(docs, PATH, 2).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    spans, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(spans) == list(range(len(texts)))
    for k, parts in [*((i, sorted(p)) for i, p in spans.items())]:
        assert [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts][:-1]]).tolist() and sum(n for _, n in parts) == len(ids[k])
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts][:-1]]).tolist() and sum(n for _, n in parts) <= 4096


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []
