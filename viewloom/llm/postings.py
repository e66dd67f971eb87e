"""Term frequencies of documents in compact blocks, joined to facts about terms and summed back per document.

Documents are taken in blocks of bounded size. A block deals its distinct terms to hash buckets and gives one row per
bucket: the terms, and each term's documents (places in the block) and frequencies there, compressed. A term of every
document so has one entry per block, and what is shuffled is close to the compressed index. Rows of a bucket meet in one
partition, streamed in order, where terms are joined to their facts with a table of one bucket's terms in memory.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.worker import lean, trimmed

BLOCK_DOCS = 4096
BLOCK_CHARS = 8 << 20
#: A row with null terms is about the block's documents: posts holds their facts, ids their ids, counts what else was kept of them.
SCHEMA = "bucket int, block long, terms binary, counts binary, posts binary, ids binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: No UTF-8 text has this byte.
SEPARATOR = b"\xff"


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_posts(df: np.ndarray, docs: np.ndarray, freqs: np.ndarray) -> bytes:
    small = freqs.max(initial=0) < 256
    return pack(bytes([int(small)]) + df.astype("<u2").tobytes() + docs.astype("<u2").tobytes() + freqs.astype("u1" if small else "<u4").tobytes())


def unpack_posts(posts: bytes, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many documents each term has; the documents, term by term; the frequencies there."""
    raw = unpack(posts)
    df = np.frombuffer(raw, "<u2", terms, 1).astype(np.int64)
    n = int(df.sum())
    docs = np.frombuffer(raw, "<u2", n, 1 + 2 * terms)
    return df, docs, np.frombuffer(raw, "u1" if raw[0] else "<u4", n, 1 + 2 * terms + 2 * n)


def pack_ids(ids: Sequence) -> bytes:
    return pack(np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes())


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and which are null."""
    raw = unpack(data)
    n = len(raw) // 9
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool)


def buckets_for(df: DataFrame) -> int:
    """A bucket for each 4 MB of input, 256 at least; beyond 4096 they grow with its square root, as vocabularies do.

    Where Spark does not know the input's size, as of rows from Python, it tells the greatest number; then there are 4096.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(256, min(size >> 22, 4096 if size >> 56 else size >> 22))
    return n if n <= 4096 else int((4096 * n) ** 0.5)


class _Block:
    def __init__(self) -> None:
        self.local: dict = defaultdict(count().__next__)
        self.terms: list[np.ndarray] = []
        self.facts: list[tuple] = []
        self.ids: list = []
        self.chars = 0

    def rows(self, block: int, buckets: int, settled: Callable | None, mark: Callable | None, extra: Callable | None) -> Iterator[tuple]:
        n = len(self.ids)
        names = list(self.local)
        facts = np.array(self.facts, np.float64).reshape(n, -1)
        kept = None
        if extra:
            of = extra(names)
            texts = [b"".join(map(of.__getitem__, t.tolist())) for t in self.terms]
            facts = np.column_stack([facts, [len(t) for t in texts]])
            kept = pack(b"".join(texts))
            del of, texts
        ids = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int32)
        where = np.repeat(np.arange(n), [len(t) for t in self.terms])
        if settled:
            known = np.fromiter((t in settled for t in names), bool, len(names))
            hit = known[ids] if len(ids) else np.zeros(0, bool)
            facts = np.column_stack([facts, np.bincount(where[hit], minlength=n)])
            ids, where = ids[~hit], where[~hit]
        raw = [t.encode() if isinstance(t, str) else t for t in names]
        home = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = np.sort(rank[ids] * n + where)
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        freqs = np.diff(first, append=len(key))
        term, docs = key[first] // n, key[first] % n
        df = np.bincount(term, minlength=len(order))
        ends = np.concatenate([[0], np.cumsum(df)])
        if mark:
            marks = np.array(mark(self.ids), np.float64)
            counts = np.bincount(term, freqs * marks[docs], len(order)).astype("<i8")
        else:
            counts = df.astype("<i8")
        starts = np.searchsorted(home[order], np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = starts[b], starts[b + 1]
            here = np.flatnonzero(df[lo:hi]) + lo
            if len(here):
                span = slice(ends[lo], ends[hi])
                yield b, block, pack(SEPARATOR.join([raw[order[i]] for i in here])), pack(counts[here].tobytes()), pack_posts(df[here], docs[span], freqs[span]), None
        yield zlib.crc32(block.to_bytes(8, "little")) % buckets, block, None, kept, pack(facts.tobytes()), pack_ids(self.ids)


def postings(docs: DataFrame, split: Callable[[str], tuple[list, tuple]], buckets: int, settled: Callable[[], frozenset] | None = None, mark: Callable[[list], Sequence[bool]] | None = None, key: str = "doc_id", text: str = "text", extra: Callable[[list], list[bytes]] | None = None) -> DataFrame:
    """Rows of SCHEMA. split: a text's terms, as they come, and facts (numbers, as many for each text); null texts are empty.

    settled: terms that are not dealt; how often a document has them is its last fact. counts: of each term the documents
    in the block, or with ``mark``, which says of ids whether they are marked, the frequency in marked documents. extra:
    what to keep of each of a block's distinct terms; of a document the bytes for its terms, as they come, are kept, and
    their length is its last fact but ``settled``'s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, _Block()
        done = settled() if settled else None

        def out() -> pa.RecordBatch:
            rows = list(held.rows(block, buckets, done, mark, extra))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], NAMES)

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py() or ""
                terms, facts = split(value)
                held.terms.append(np.fromiter(map(held.local.__getitem__, terms), np.int32, len(terms)))
                held.facts.append(facts)
                held.ids.append(i)
                held.chars += len(value)
                if len(held.ids) >= BLOCK_DOCS or held.chars >= BLOCK_CHARS:
                    yield out()
                    block, held = block + 1, _Block()
        if held.ids:
            yield out()

    return lean(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), SCHEMA)


class Lookup:
    """The facts of terms, for one bucket at a time. Overridden: ``columns`` weights a term, ``weights`` finds them."""

    columns = 1

    def begin(self) -> None:
        """A new bucket comes."""

    def learn(self, terms: list[bytes], counts: np.ndarray) -> None:
        """The bucket's row of the dictionary, before any postings."""

    def weights(self, terms: list[bytes]) -> np.ndarray:
        """A row per column, a column per term."""
        raise NotImplementedError


def dictionary(kept: DataFrame) -> DataFrame:
    """One row per bucket: its distinct terms and the sums of their counts, over all blocks; n_terms and total besides.

    Terms with a sum of 0 are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}

        def out() -> pa.RecordBatch:
            names = [t for t, n in known.items() if n]
            sums = np.array([known[t] for t in names], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack(SEPARATOR.join(names))], pa.binary()), pa.array([pack(sums.tobytes())], pa.binary()), pa.array([len(names)], pa.int64()), pa.array([int(sums.sum())], pa.int64())], ["bucket", "terms", "counts", "n_terms", "total"])

        for batch in batches:
            for b, terms, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if known:
                        yield out()
                    bucket, known = b, {}
                for t, n in zip(unpack(terms).split(SEPARATOR), np.frombuffer(unpack(counts), "<i8").tolist(), strict=True):
                    known[t] = known.get(t, 0) + n
        if known:
            yield out()

    rows = kept.filter("terms IS NOT NULL").select("bucket", "terms", "counts")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "bucket int, terms binary, counts binary, n_terms long, total long")


def sum_by_document(rows: DataFrame, lookup: Callable[[], Lookup], finish: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]], schema: str, facts: DataFrame | None = None) -> DataFrame:
    """Sums of frequency x weight over each document's terms; one row per row of the documents.

    facts: the rows of ``dictionary``, given to ``Lookup.learn`` before the bucket's postings. finish(sums, facts) gives
    the result's columns after the id, from arrays of a row per document; ``schema`` names all of them.
    """
    mixed = rows.select("bucket", F.lit(1).alias("kind"), "block", "terms", F.lit(None).cast("binary").alias("counts"), "posts", "ids")
    if facts is not None:
        empty = F.lit(None).cast("binary")
        mixed = mixed.unionByName(facts.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "terms", "counts", empty.alias("posts"), empty.alias("ids")))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        bucket, found = None, lookup()
        k = found.columns

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["block", "docs", "sums", "ids"])

        def sums() -> pa.RecordBatch:
            got = [(b, np.flatnonzero(a.any(0)), a) for b, a in held.items()]
            held.clear()
            return out([(b, pack(at.astype("<u2").tobytes()), pack(a[:, at].tobytes()), None) for b, at, a in got])

        for batch in batches:
            about = []
            for b, kind, block, terms, counts, posts, ids in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if ids is not None:
                    about.append((block, None, posts, ids))
                    continue
                if b != bucket:
                    bucket = b
                    found.begin()
                names = unpack(terms).split(SEPARATOR)
                if kind == 0:
                    found.learn(names, np.frombuffer(unpack(counts), "<i8"))
                    continue
                if block not in held:
                    if len(held) >= 256:  # 256 blocks of 4096 documents take 8 MB for each column
                        yield sums()
                    held[block] = np.zeros((k, BLOCK_DOCS))
                df, docs, freqs = unpack_posts(posts, len(names))
                for total, w in zip(held[block], found.weights(names), strict=True):
                    total += np.bincount(docs, np.repeat(w, df) * freqs, BLOCK_DOCS)
            if about:
                yield out(about)
        if held:
            yield sums()

    def whole(table: pa.Table) -> pa.Table:
        got = table.select(["docs", "sums", "ids"]).to_pylist()
        head = next(r for r in got if r["ids"] is not None)
        ids, nulls = unpack_ids(head["ids"])
        about = np.frombuffer(unpack(head["sums"]), np.float64).reshape(len(ids), -1)
        total = np.zeros((lookup().columns, len(ids)))
        for r in got:
            if r["ids"] is None:
                at = np.frombuffer(unpack(r["docs"]), "<u2")
                total[:, at] += np.frombuffer(unpack(r["sums"]), np.float64).reshape(len(total), -1)
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(ids, mask=nulls), *[pa.array(c) for c in finish(total, about)]], names)

    parts = mixed.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(trimmed(partial), "block long, docs binary, sums binary, ids binary")
    return parts.groupBy("block").applyInArrow(whole, schema)
