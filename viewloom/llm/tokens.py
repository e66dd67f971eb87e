"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies, and summed.

No token ids are made for texts. A pre-token that is an entry of the vocabulary and encodes to itself has one piece; that
is found when the vocabulary is loaded, a table whose size the file bounds, so the most frequent pre-tokens need no join.
All others are counted once each and joined. Null texts count as empty, repeated rows each get a row, and texts of any
length are counted whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from viewloom.llm.postings import Lookup, buckets_for, postings, sum_by_document

#: White space as the tokenizer's pattern has it (Unicode's property), which Python's own class exceeds.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The byte-level tokenizer's split of a text into pre-tokens.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(4)
def _loaded(path: str):
    """The tokenizer, its special strings as a pattern, and the pre-tokens that are one piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    entries = [e for e in (t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())) if "\ufffd" not in e and e not in special and PRETOKEN.fullmatch(e)]
    single = frozenset(e for e, got in zip(entries, t.encode_batch_fast(entries, add_special_tokens=False), strict=True) if len(got.ids) == 1)
    return t, regex.compile("|".join(map(regex.escape, special))) if special else None, single


def split(text: str, path: str) -> tuple[list[str], tuple[int, int]]:
    """The text's pre-tokens; its bytes, and the special strings in it."""
    special = _loaded(path)[1]
    if special is None or not special.search(text):
        return PRETOKEN.findall(text), (len(text.encode()), 0)
    parts = special.split(text)
    return [t for part in parts for t in PRETOKEN.findall(part)], (len(text.encode()), len(parts) - 1)


class Pieces(Lookup):
    """How many pieces a pre-token has; each of a bucket's distinct pre-tokens is encoded once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _loaded(path)[0]
        self.known: dict[bytes, int] = {}

    def begin(self) -> None:
        self.known = {}

    def weights(self, terms: list[bytes]) -> np.ndarray:
        new = [t for t in terms if t not in self.known]
        for t, e in zip(new, self.tokenizer.encode_batch_fast([t.decode() for t in new], add_special_tokens=False), strict=True):
            self.known[t] = len(e.ids)
        return np.fromiter(map(self.known.__getitem__, terms), np.float64, len(terms))[None]


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``path``: a byte-level tokenizer's JSON file."""
    rows = postings(docs, lambda value: split(value, path), buckets_for(docs), lambda: _loaded(path)[2], None, key, text)

    def finish(sums: np.ndarray, facts: np.ndarray) -> list[np.ndarray]:
        tokens = np.rint(sums[0] + facts[:, 1] + facts[:, 2]).astype(np.int64)
        return [facts[:, 0].astype(np.int64), tokens, tokens > limit]

    return sum_by_document(rows, lambda: Pieces(path), finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
