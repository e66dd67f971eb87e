"""Subword ids of single words, for tokenizers that drop white space and mark the ends of words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words that are encoded as one text.
CHUNK = 512


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _closing(path: str) -> np.ndarray:
    """Whether an id ends a word."""
    t = tokenizer(path)
    suffix = getattr(t.model, "end_of_word_suffix", None) or "</w>"
    return np.array([(t.id_to_token(i) or "").endswith(suffix) for i in range(t.get_vocab_size())])


def _each(words: list[str], path: str, kind: str) -> list[bytes]:
    out: list[bytes] = []
    for at in range(0, len(words), 20_000):
        out += [np.array(e.ids, kind).tobytes() for e in tokenizer(path).encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
    return out


def _chunks(words: list[str], path: str, kind: str) -> Iterator[list[bytes]]:
    closing, size = _closing(path), np.dtype(kind).itemsize
    parts = [words[at : at + CHUNK] for at in range(0, len(words), CHUNK)]
    for at in range(0, len(parts), 64):
        group = parts[at : at + 64]
        for part, e in zip(group, tokenizer(path).encode_batch_fast([" ".join(p) for p in group], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            cut = ((np.flatnonzero(closing[ids]) + 1) * size).tolist()
            if len(cut) != len(part):  # some letters are split from others
                yield _each(part, path, kind)
            else:
                raw = ids.tobytes()
                yield [raw[lo:hi] for lo, hi in zip([0, *cut], cut)]


def encode_words(words: list[bytes], path: str, kind: str = "<u4") -> list[bytes]:
    """The ids of each word, as numbers of ``kind``. Words of letters only go to the tokenizer together, as its cost is by text."""
    texts = [w.decode() for w in words]
    plain = [i for i, w in enumerate(texts) if w.isalpha()]
    out: list[bytes] = [b""] * len(texts)
    found = (ids for part in _chunks([texts[i] for i in plain], path, kind) for ids in part)
    for i, ids in zip(plain, found, strict=True):
        out[i] = ids
    others = [i for i, w in enumerate(texts) if not w.isalpha()]
    for i, ids in zip(others, _each([texts[i] for i in others], path, kind), strict=True):
        out[i] = ids
    return out
