"""Exact top-k search by BM25 over an inverted index, with block-max pruning in each shard and an exact merge.

The index holds every row: shards of bounded size, whose postings are dealt to term buckets (see ``postings``). Document
frequencies and the mean length are those of the whole collection, so scores don't depend on shards. A query is the set of
all words of its text. Queries go in batches; a cell is a batch and a group of shards, and gets the batch once and each of
its shards' postings of the batch's terms once. No posting carries the queries that ask for it.

In a cell, queries of a kind go through the shards together. Lists of many documents are a matrix, so their parts in many
documents' scores are one product; those of other lists are summed. The bound of a block of documents is the largest sum
there and the largest parts of the matrix's lists; blocks whose bounds reach no query's k-th best score so far are left
out, and later shards start with the scores of earlier ones. The product is in single precision: what may be among the
best by it is summed again in double. The cells' best are merged.

Scores are rounded to six decimals; equal ones go by id. Equal queries run once. Null texts are empty; queries without
words give no rows; rows with null ids are counted but not returned; repeated rows are returned and asked as often as they
come.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.postings import SEPARATOR, buckets_for, dictionary, pack, postings, unpack, unpack_ids, unpack_posts
from viewloom.llm.store import keep
from viewloom.llm.worker import trimmed


@dataclass(frozen=True)
class Settings:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    #: Documents of a block.
    block: int = 64
    #: Queries of a batch: about 700 bytes each in a task. Each batch more reads the index once more.
    batch: int = 65_536
    #: Queries that go through a shard together.
    together: int = 128
    #: Shards of a cell, if there are enough for all cores.
    shards: int = 8


def words(text: str) -> list[bytes]:
    """A-Z lowered, cut at ASCII white space."""
    return text.encode().lower().split()


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


#: More than rounding moves a score.
SLACK = 2e-6


class Batch:
    """Queries as rows of places in ``terms`` (sorted ids), and the k best of each so far.

    Queries are told apart by the kinds of their most common words, so that those of one language are looked for together.
    """

    #: Kinds, the words that tell them, and the queries that they are found from. They change the order of work only.
    KINDS, COMMON, FIRST = 8, 256, 4096

    def __init__(self, packs: list[bytes], k: int) -> None:
        got = [np.load(_file(p)) for p in packs]
        self.terms, first = np.unique(np.concatenate([g["terms"] for g in got]), return_index=True)
        self.idf = np.concatenate([g["idf"] for g in got])[first]
        self.rows = np.concatenate([g["rows"] for g in got])
        self.wants = [w.astype(np.int32) for g in got for w in np.split(np.searchsorted(self.terms, g["terms"])[g["at"]], g["ends"][:-1])]
        self.k = k
        self.scores = np.full((len(self.rows), k), -np.inf)
        self.ids = np.zeros((len(self.rows), k), np.int64)
        self._tell_kinds()

    def _tell_kinds(self) -> None:
        often = np.bincount(np.concatenate(self.wants), minlength=len(self.terms))
        self.common = np.sort(np.argsort(-often, kind="stable")[: self.COMMON])
        self.common_of = np.full(len(self.terms), -1)
        self.common_of[self.common] = np.arange(len(self.common))
        x = np.zeros((len(self.rows), len(self.common)), np.float32)
        for q, w in enumerate(self.wants):
            at = self.common_of[w]
            x[q, at[at >= 0]] = 1
        x /= np.maximum(1, np.sqrt(x.sum(1)))[:, None]
        some = x[: self.FIRST]
        self.centres, near = some[:1], np.zeros(len(some), np.float32)
        while len(self.centres) < min(self.KINDS, len(some)):
            near = np.maximum(near, some @ self.centres[-1])
            self.centres = np.vstack([self.centres, some[near.argmin()]])
        for _ in range(6):
            kind = (some @ self.centres.T).argmax(1)
            self.centres = np.stack([some[kind == j].sum(0) for j in range(len(self.centres))])
            self.centres /= np.maximum(1e-6, np.sqrt((self.centres**2).sum(1)))[:, None]
        self.order = np.argsort((x @ self.centres.T).argmax(1), kind="stable")

    def floors(self, asked: np.ndarray) -> np.ndarray:
        """What a document's score has to reach, for each of these queries."""
        return np.maximum(self.scores[asked, -1] - SLACK, SLACK / 4)

    def add(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Documents found, each for the query at its row of ``asked``."""
        n, k = len(asked), self.k
        rows = np.concatenate([np.repeat(np.arange(n), k), rows])
        ids, scores = np.concatenate([self.ids[asked].ravel(), ids]), np.concatenate([self.scores[asked].ravel(), scores])
        order = np.lexsort((ids, -scores, rows))
        starts = np.searchsorted(rows[order], np.arange(n))
        best = order[starts[:, None] + np.arange(k)]
        self.ids[asked], self.scores[asked] = ids[best], scores[best]


def _file(data: bytes):
    import io

    return io.BytesIO(unpack(data))


def pack_queries(rows: list[int], wants: list[list[int]], idfs: list[list[float]]) -> bytes:
    """Some queries in one binary: term ids are held once."""
    import io

    flat = np.concatenate([np.array(w, np.int64) for w in wants])
    terms, first, at = np.unique(flat, return_index=True, return_inverse=True)
    out = io.BytesIO()
    np.savez(out, rows=np.array(rows, np.int64), terms=terms, idf=np.concatenate([np.array(x) for x in idfs])[first], at=at.astype("<i4"), ends=np.cumsum([len(w) for w in wants]))
    return pack(out.getvalue())


class Shard:
    """The postings of a batch's terms in one shard: documents and score parts by list.

    Documents are ordered by kind and number of words, so that those of a block are alike. Lists of many documents are rows
    of a matrix, with each one's largest part in each block.
    """

    #: A list of more than this part of the shard's documents is a row of the matrix, which has so many cells at most.
    PART, CELLS = 24, 1 << 22
    #: Postings that are summed at once.
    AT_ONCE = 1 << 20

    def __init__(self, batch: Batch, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, freqs: np.ndarray, lengths: np.ndarray, mean: float, s: Settings) -> None:
        n = len(lengths)
        self.s = s
        self.blocks = -(-n // s.block)
        self.width = self.blocks * s.block
        place = np.searchsorted(batch.terms, terms)
        self.list_of = np.full(len(batch.terms), -1)
        self.list_of[place] = np.arange(len(terms))
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        docs, which = docs.astype(np.int64), np.repeat(np.arange(len(terms)), df)
        damp = s.k1 * (1 - s.b + s.b * lengths / mean)
        self.parts = np.repeat(batch.idf[place], df) * freqs * (s.k1 + 1) / (freqs + damp[docs])
        told = batch.common_of[place][which]
        near = np.zeros((len(batch.centres), n), np.float32)
        for j, centre in enumerate(batch.centres):
            near[j] = np.bincount(docs[told >= 0], centre[told[told >= 0]], n)
        self.order = np.lexsort((np.bincount(docs, minlength=n), near.argmax(0)))
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        self.docs = rank[docs]
        often = np.flatnonzero(df >= max(4, n // self.PART))
        most = max(1, self.CELLS // max(1, self.width))
        often = often[np.argsort(-df[often], kind="stable")[:most]]
        self.dense_of = np.full(len(terms), -1)
        self.dense_of[often] = np.arange(len(often))
        inside = np.flatnonzero(self.dense_of[which] >= 0)
        #: By document, and by list in single precision.
        self.exact = np.zeros((self.width, len(often)))
        self.exact[self.docs[inside], self.dense_of[which[inside]]] = self.parts[inside]
        self.dense = np.ascontiguousarray(self.exact.T, np.float32)
        self.tops = self.dense.reshape(len(often), self.blocks, s.block).max(2)
        #: More than single precision moves a sum of a document's parts, as a share of it.
        self.share = (len(often) + 16) * 2.0**-22

    def _rest(self, n: int, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """For each of n queries the sums over its lists outside the matrix, by document."""
        size = n * self.width
        total = np.zeros(size)
        df = self.ends[lists] - self.starts[lists]
        cuts = np.searchsorted(np.cumsum(df), np.arange(self.AT_ONCE, df.sum(), self.AT_ONCE))
        for part in np.split(np.arange(len(lists)), cuts):
            m = df[part]
            at = np.repeat(self.starts[lists[part]] - (np.cumsum(m) - m), m)
            at += np.arange(len(at))
            key = np.repeat(rows[part] * self.width, m)
            key += self.docs[at]
            total += np.bincount(key, self.parts[at], size)
        return total.reshape(n, self.width)

    def _found(self, batch: Batch, asked: np.ndarray, wanted: np.ndarray, rest: np.ndarray, lo: int, hi: int, ids: np.ndarray) -> None:
        """Put the documents at lo to hi - 1 that are among a query's k best into the batch."""
        total = wanted @ self.dense[:, lo:hi]
        total += rest[:, lo:hi]
        floor = batch.floors(asked)
        hit = total >= (floor * (1 - self.share))[:, None]
        if hit.sum() > 4 * batch.k * len(asked) and hi - lo > batch.k:
            kth = np.partition(total, -batch.k, axis=1)[:, -batch.k].astype(np.float64)  # as many documents are no worse, but for rounding
            hit &= total >= np.where(kth > 0, kth * (1 - 2 * self.share) - 2 * SLACK, -np.inf)[:, None]
        rows, at = np.nonzero(hit)
        step = max(1, (1 << 20) // max(1, len(self.tops)))
        scores = np.zeros(len(rows))
        for i in range(0, len(rows), step):
            r, d = rows[i : i + step], at[i : i + step] + lo
            scores[i : i + step] = np.round(rest[r, d] + np.einsum("ij,ij->i", wanted[r], self.exact[d]), 6)
        good = scores >= floor[rows]
        if good.any():
            batch.add(asked, rows[good], ids[self.order[at[good] + lo]], scores[good])

    def search(self, batch: Batch, asked: np.ndarray | int, ids: np.ndarray, nulls: np.ndarray) -> int:
        """Put the shard's documents that are among the k best of these queries into the batch; the number of blocks that were scored."""
        asked = np.atleast_1d(asked)
        wants = [batch.wants[q] for q in asked.tolist()]
        rows, lists = np.repeat(np.arange(len(asked)), [len(w) for w in wants]), self.list_of[np.concatenate(wants)]
        rows, lists = rows[lists >= 0], lists[lists >= 0]
        if not len(lists):
            return 0
        place = self.dense_of[lists]
        wanted = np.zeros((len(asked), len(self.tops)), np.float32)
        wanted[rows[place >= 0], place[place >= 0]] = 1
        rest = self._rest(len(asked), rows[place < 0], lists[place < 0])
        rest[:, len(self.order) :] = -np.inf
        rest[:, np.flatnonzero(nulls[self.order])] = -np.inf
        bound = rest.reshape(len(asked), self.blocks, -1).max(2)
        bound += wanted @ self.tops
        left, scored = np.ones(self.blocks, bool), 0
        while True:
            alive = np.flatnonzero((bound >= (batch.floors(asked) * (1 - self.share))[:, None]).any(0) & left)
            if not len(alive):
                return scored
            if not scored and not np.isfinite(batch.scores[asked, -1]).all():  # the best blocks first
                alive = np.sort(alive[np.argsort(-np.maximum(bound[:, alive], 0).sum(0), kind="stable")[: max(1, self.blocks // 8)]])
            left[alive] = False
            scored += len(alive)
            for run in np.split(alive, np.flatnonzero(np.diff(alive) > 1) + 1):
                self._found(batch, asked, wanted, rest, int(run[0]) * self.s.block, (int(run[-1]) + 1) * self.s.block, ids)


def _streams(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each bucket's row of ``facts`` (kind 0) before its ``rows`` (kind 1)."""
    return facts.unionByName(rows).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _null(kind: str):
    return F.lit(None).cast(kind)


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)


def _query_terms(queries: DataFrame, known: DataFrame, n: int, buckets: int, key: str, text: str) -> DataFrame:
    """row, query_id, bucket, term, id and idf of each query row's distinct words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                out = [(zlib.crc32(t) % buckets, row, i, t) for t in set(words(value.as_py() or ""))]
                yield _table(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), ["bucket", "row", "query_id", "term"])

    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(cut), "bucket int, row long, query_id long, term binary")
    rows = asked.select("bucket", F.lit(1).alias("kind"), "row", "query_id", "term", _null("binary").alias("terms"), _null("binary").alias("counts"))
    facts = known.select("bucket", F.lit(0).alias("kind"), _null("long").alias("row"), _null("long").alias("query_id"), _null("binary").alias("term"), "terms", "counts")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, int] = {}
        dfs: list[int] = []
        for batch in batches:
            out: list[tuple] = []
            for b, kind, row, i, term, terms, counts in zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True):
                if kind == 0:
                    places = {t: at for at, t in enumerate(unpack(terms).split(SEPARATOR))}
                    dfs = np.frombuffer(unpack(counts), "<i8").tolist()
                else:
                    out.append((row, i, b, term, b << 32 | places[term], idf(n, dfs[places[term]])))
            yield _table(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64()), ["row", "query_id", "bucket", "term", "id", "idf"])

    return _streams(facts, rows).mapInArrow(trimmed(weigh), "row long, query_id long, bucket int, term binary, id long, idf double")


def top_k(docs: DataFrame, queries: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents with a word of the query, for each row of ``queries``."""
    s = settings or Settings()
    buckets = buckets_for(docs)

    def split(value: str) -> tuple[list, tuple]:
        found = words(value)
        return found, (len(found),)

    index = keep(postings(docs, split, buckets, key=key, text=text), "index")
    about = index.filter("terms IS NULL").select("block", "posts", "ids")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [np.frombuffer(unpack(p)) for batch in batches for p in batch.column(1).to_pylist()]
        yield _table([(sum(map(len, lengths)), int(sum(x.sum() for x in lengths)), len(lengths))], (pa.int64(),) * 3, ["n", "total", "shards"])

    got = about.mapInArrow(sizes, "n long, total long, shards long").agg(F.sum("n"), F.sum("total"), F.sum("shards")).first()
    n, mean, shards = got[0] or 0, max(1, got[1] or 0) / max(1, got[0] or 0), got[2] or 0
    known = keep(dictionary(index).select("bucket", "terms", "counts"), "frequencies")
    chosen = keep(_query_terms(queries, known, n, buckets, key, text), "queries")
    sorted_terms = F.array_sort(F.collect_list(F.struct("id", "idf")))
    by_row = chosen.groupBy("row", "query_id").agg(sorted_terms.alias("terms")).withColumn("query", F.sha2(F.array_join(F.transform("terms", lambda t: t["id"].cast("string")), ","), 256))
    asked = keep(by_row, "asked")
    one = keep(asked.groupBy("query").agg(F.min("row").alias("row")), "distinct")
    batches_n = max(1, -(-one.count() // s.batch))
    batch_of = lambda row: F.pmod(F.xxhash64(row), F.lit(batches_n)).cast("int")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(shards, max(2 * cores, -(-shards // s.shards))))
    cell_of = lambda group, batch: (group * F.lit(batches_n).cast("long") + batch).alias("cell")

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held = None, []

        def out() -> pa.RecordBatch:
            made = [(batch, pack_queries(*zip(*held)))] if held else []
            held.clear()
            return _table(made, (pa.int32(), pa.binary()), ["batch", "pack"])

        for part in rows:
            for b, row, terms in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
                if b != batch or len(held) >= 512:
                    yield out()
                    batch = b
                held.append((row, [t["id"] for t in terms], [t["idf"] for t in terms]))
        yield out()

    alone = asked.join(one.select("row"), "row").select(batch_of("row").alias("batch"), "row", "terms")
    packs = keep(alone.sortWithinPartitions("batch").mapInArrow(gather, "batch int, pack binary"), "packs")
    # which batches want a term, and where its postings are
    terms = chosen.join(one, "row").groupBy("bucket", "term", "id").agg(F.collect_set(batch_of("row")).alias("batches"))
    wanted = terms.groupBy("bucket").agg(F.collect_list(F.struct("term", "id", "batches")).alias("wanted"))
    facts = wanted.select("bucket", F.lit(0).alias("kind"), _null("long").alias("block"), _null("binary").alias("terms"), _null("binary").alias("posts"), "wanted")
    rows = index.filter("terms IS NOT NULL").select("bucket", F.lit(1).alias("kind"), "block", "terms", "posts", _null(wanted.schema["wanted"].dataType.simpleString()).alias("wanted"))
    names = ["batch", "block", "terms", "posts"]

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings of a bucket in a shard that a batch wants, in one row."""
        bucket, want = None, []
        for part in parts:
            out: list[tuple] = []
            for b, kind, block, terms, posts, queried in zip(*(part.column(j).to_pylist() for j in range(6)), strict=True):
                if b != bucket:
                    bucket, want = b, []
                if kind == 0:
                    want = [{w["term"]: w["id"] for w in queried if batch in w["batches"]} for batch in range(batches_n)]
                elif want:
                    there = unpack(terms).split(SEPARATOR)
                    df, at, freqs = unpack_posts(posts, len(there))
                    ends = np.cumsum(df)
                    for batch, mine in enumerate(want):
                        hits = np.array([j for j, t in enumerate(there) if t in mine], np.int64)
                        if len(hits):
                            place = np.concatenate([np.arange(ends[j] - df[j], ends[j]) for j in hits])
                            ids = np.array([mine[there[j]] for j in hits], "<i8")
                            out.append((batch, block, ids.tobytes(), pack(df[hits].astype("<u2").tobytes() + at[place].tobytes() + freqs[place].astype("<u4").tobytes())))
            yield _table(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), names)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, packed, batch = None, [], None
        shard, head, held = None, None, []

        def found() -> pa.RecordBatch:
            at = np.nonzero(np.isfinite(batch.scores)) if batch else (np.zeros(0, int),) * 2
            cols = (batch.rows[at[0]], batch.ids[at], batch.scores[at]) if batch else (at[0], at[0], at[0].astype(float))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["row", "doc_id", "score"])

        def run() -> None:
            nonlocal batch, packed
            if not held or head is None or not (packed or batch):
                return
            if packed:
                batch, packed = Batch(packed, s.k), []
            ids, nulls = unpack_ids(head[1])
            lists, df, at, freqs = [], [], [], []
            for terms, posts in held:
                t, raw = np.frombuffer(terms, "<i8"), unpack(posts)
                d = np.frombuffer(raw, "<u2", len(t)).astype(np.int64)
                lists.append(t)
                df.append(d)
                at.append(np.frombuffer(raw, "<u2", d.sum(), 2 * len(t)))
                freqs.append(np.frombuffer(raw, "<u4", d.sum(), 2 * len(t) + 2 * d.sum()))
            made = Shard(batch, *(np.concatenate(x) for x in (lists, df, at, freqs)), np.frombuffer(unpack(head[0])), mean, s)
            for q in range(0, len(batch.rows), s.together):
                made.search(batch, batch.order[q : q + s.together], ids, nulls)

        for part in parts:
            for c, kind, block, terms, posts, ids in zip(*(part.column(j).to_pylist() for j in range(6)), strict=True):
                if c != cell or block != shard:
                    run()
                    shard, head, held = block, None, []
                if c != cell:
                    if batch:
                        yield found()
                    cell, packed, batch = c, [], None
                if kind == 0:
                    packed.append(posts)
                elif ids is not None:
                    head = (posts, ids)
                else:
                    held.append((terms, posts))
        run()
        yield found()

    group_of = F.pmod(F.xxhash64("block"), F.lit(groups))
    none = _null("binary")
    picked = _streams(facts, rows).mapInArrow(trimmed(pick), "batch int, block long, terms binary, posts binary")
    lists = picked.select(cell_of(group_of, F.col("batch")), F.lit(1).alias("kind"), "block", "terms", "posts", none.alias("ids"))
    heads = about.select("block", "posts", "ids", F.explode(F.sequence(F.lit(0), F.lit(batches_n - 1))).alias("batch")).select(cell_of(group_of, F.col("batch")), F.lit(1).alias("kind"), "block", none.alias("terms"), "posts", "ids")
    asking = packs.select("batch", "pack", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).select(cell_of(F.col("group"), F.col("batch")), F.lit(0).alias("kind"), _null("long").alias("block"), none.alias("terms"), F.col("pack").alias("posts"), none.alias("ids"))
    # a cell is much work for few bytes: their number is given, so that none are put together by size
    cells = asking.unionByName(lists).unionByName(heads).repartition(min(groups * batches_n, 1 << 15), "cell").sortWithinPartitions("cell", "kind", "block")
    best = cells.mapInArrow(trimmed(search), "row long, doc_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    merged = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k)
    return asked.select("query_id", "query").join(one, "query").join(merged, "row").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
