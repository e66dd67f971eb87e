"""Token counts against the library itself."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from viewloom.llm.tokens import Pieces, _loaded, split, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "It's  we'll\n\n x<|endoftext|>y <|endoftext|>", "é" * 300, "word " * 3000, "\x1c a　b\x85 c", "12 345 ½²", "日本語 テキスト", "word " * 3000]


def want(text):
    t = Tokenizer.from_file(PATH)
    return len(t.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x1c\x1f\x85 　'sdltrevmab1½.,!é"), st.characters(codec="utf-8")), max_size=60))
def test_split_matches_library(text):
    t = _loaded(PATH)[0]
    terms, (_, special) = split(text, PATH)
    assert special + Pieces(PATH).weights([p.encode() for p in terms]).sum() == len(t.encode(text, add_special_tokens=False).ids)
    assert all(len(t.encode(p, add_special_tokens=False).ids) == 1 for p in terms if p in _loaded(PATH)[2])


def test_counts(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, term string")
    got = sorted(map(tuple, token_counts(docs, PATH, 1024).collect()), key=str)
    assert got == sorted([(i if i else None, len((t or "").encode()), want(t), want(t) > 1024) for i, t in enumerate(TEXTS)], key=str)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, 1024).collect() == []
