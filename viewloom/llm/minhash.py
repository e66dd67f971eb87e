"""Near-duplicate detection by MinHash: universal hash minima, banding, signature verification, exact confirmation, components.

Documents with equal shingle sets are one class, found by a hash of the set. Classes meet in buckets, one for each band
of their signature. In a first round each class of a bucket is compared only with the bucket's centre, the class that
meets most others; links that both signatures and full sets confirm give components. In a second round, classes of a
bucket that are still in different components are compared, in blocks of bounded number and bytes, within tasks, by
signatures and 32-bit sets; only links that join components leave them, to be confirmed. So no group emits its pairs, and
no two components that a link joins are left apart. Buckets of very many blocks are first cut by further parts of the
signatures, of which a pair of similarity 0.8 shares none with a probability of 2e-11.

With b bands of r minima, a pair of similarity s shares a bucket with probability 1 - (1 - s^r)^b: at 0.8, 32 bands of 4
miss one pair in 10^7. Signature estimates below the threshold by over ``slack`` are dropped; at 0.8 that loses a pair with a
probability of 2e-7.

Defined results: rows without words have no shingles and no links; rows with fewer words than a shingle have one, the
whole sequence; repeated rows are copies of each other; null ids have no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.components import components
from viewloom.llm.store import keep
from viewloom.llm.worker import fresh, held, lean, trimmed


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    slack: float = 0.2
    #: Classes of a bucket, and bytes of their sets, that are compared with as many others in one task, about.
    block: int = 256
    block_bytes: int = 4 << 20
    #: Buckets of more blocks are cut by pairs of minima, so many of them.
    blocks: int = 16
    parts: int = 24
    #: Parts that the classes of a component are dealt to.
    salts: int = 32
    #: Classes whose ids may be broadcast, 8 bytes each.
    broadcast: int = 2_000_000

    @property
    def minima(self) -> int:
        return self.bands * self.rows


class _Words(dict):
    """Word -> 64-bit hash; holds a bounded number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_ODD = np.random.default_rng(20).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. A-Z are lowered; words are cut at ASCII white space."""
    found = (text or "").encode().lower().split()
    h = np.fromiter(map(held("words", _Words).__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"few" + h.tobytes())], np.uint64)
    out = np.zeros(len(h) - words + 1, np.uint64)
    for j in range(words):
        out = _mix(out * _ODD[j] + h[j : len(h) - words + 1 + j])
    return np.unique(out)


def coefficients(minima: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2)
    return rng.integers(0, 1 << 63, minima, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, minima, np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each multiply-shift hash over the shingles."""
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    x = found >> np.uint64(32) ^ found & np.uint64(0xFFFFFFFF)
    for at in range(0, len(x), 512):
        h = np.multiply.outer(a, x[at : at + 512])
        h += b[:, None]
        np.minimum(out, (h.min(1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows of one id but different texts apart."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def sketches(docs: DataFrame, s: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, class (a hash of the shingle set; null without shingles) and signature of each row."""
    names = ["doc_id", "row", "n_shingles", "class", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(s.minima)
        for batch in batches:
            n, classes, signatures = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py(), s.words)
                n.append(len(found))
                classes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                signatures.append(signature(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())], names)

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(key, text).alias("row"))
    return rows.mapInArrow(trimmed(run), "doc_id long, row long, n_shingles long, class long, signature binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, of sorted distinct hashes."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _passing(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow the similarity."""
    left = reps.select(F.col("class").alias("u"), F.col("n").alias("n_u"), F.col("signature").alias("s_u"))
    right = reps.select(F.col("class").alias("v"), F.col("n").alias("n_v"), F.col("signature").alias("s_v"))
    sized = pairs.join(left, "u").join(right, "v").filter(s.percent * F.greatest("n_u", "n_v") <= 100 * F.least("n_u", "n_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, s.minima) for i in (2, 3))
                yield batch.select(["u", "v"]).filter(pa.array((u == v).mean(1) >= s.percent / 100 - s.slack))

    return sized.select("u", "v", "s_u", "s_v").mapInArrow(trimmed(run), "u long, v long")


def _texts(classes: DataFrame, reps: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """class, text for each of ``classes``; an id that comes with several texts gives more, of other classes."""
    need = keep(classes.distinct().join(reps.select("class", "doc_id"), "class"), "need")
    few = need.count() <= s.broadcast
    return docs.join(F.broadcast(need) if few else need, "doc_id").select("class", "text")


def _class(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs of classes whose full shingle sets have the similarity, from the texts of their representatives."""
    pairs = keep(pairs, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("class")), reps, docs, s)
    left, right = texts.select(F.col("class").alias("u"), F.col("text").alias("t_u")), texts.select(F.col("class").alias("v"), F.col("text").alias("t_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            ok = []
            for u, v, t_u, t_v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if v != last[0]:
                    last = (v, shingles(t_v.as_py(), s.words))
                    last = last if _class(last[1]) == v else (None, last[1])
                mine = shingles(t_u.as_py(), s.words)
                ok.append(last[0] == v and _class(mine) == u and similar(mine, last[1], s.percent))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "t_u", "t_v").mapInArrow(trimmed(run), "u long, v long").distinct()


def _sets(classes: DataFrame, reps: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """class, items: its shingles as sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), s.words) for t in batch.column(1)]
            right = pa.array([_class(x) == c for x, c in zip(found, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            items = pa.array([np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["class", "items"]).filter(right)

    return _texts(classes, reps, docs, s).mapInArrow(trimmed(run), "class long, items binary").dropDuplicates(["class"])


def cell_links(band: np.ndarray, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, own: np.ndarray, sigs: np.ndarray, items: list[np.ndarray], s: Settings) -> list[tuple[int, int]]:
    """Links between components among the classes of one cell: for each two components of which any classes link here, at
    least one link, and every link too near the threshold to be sure by 32-bit hashes.

    A pair is left to the cell of the first band that it shares.
    """
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    names, inverse, counts = np.unique(comps, return_inverse=True, return_counts=True)
    cross = own.min() != own.max()
    keys = sigs.reshape(len(sigs), s.bands, s.rows)
    out: list[tuple[int, int]] = []
    largest = counts.argmax()
    for i in np.flatnonzero(inverse != largest):
        near = (comps != comps[i]) & (s.percent * np.maximum(sizes, sizes[i]) <= 100 * np.minimum(sizes, sizes[i]))
        if cross:
            near &= own != own[i]
        # pairs of two smaller components come up from both sides; one is enough
        near &= (inverse == largest) | (ids < ids[i])
        at = np.flatnonzero(near)
        if not len(at):
            continue
        alike = (sigs[at] == sigs[i]).mean(1)
        first = (keys[at] == keys[i]).all(2).argmax(1) == band[i]
        ok = (alike >= s.percent / 100 - s.slack) & first
        at = at[ok][np.argsort(-alike[ok], kind="stable")]
        mine = items[i]
        for lo in range(0, len(at), 64):
            part = [j for j in at[lo : lo + 64].tolist() if root(int(comps[j])) != root(int(comps[i]))]
            if not part:
                continue
            both = np.add.reduceat(np.isin(np.concatenate([items[j] for j in part]), mine, kind="sort"), np.cumsum([0, *[len(items[j]) for j in part[:-1]]]))
            for j, n in zip(part, both.tolist(), strict=True):
                total = int(sizes[i] + sizes[j])
                if 100 * (n + 3) >= s.percent * (total - n - 3) and root(int(comps[j])) != root(int(comps[i])):
                    out.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
                    if 100 * (n - 3) >= s.percent * (total - n + 3):
                        parent[root(int(comps[i]))] = root(int(comps[j]))
    return out


def _cells(members: DataFrame, s: Settings) -> DataFrame:
    """Pairs (u, v) of classes of one bucket, in different components, that probably link; see ``cell_links``.

    members: bucket, band, blocks, class, component, size, signature, items. A bucket is cut in blocks, and each pair of
    blocks is a cell of its own.
    """
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    names = ["class", "component", "size", "own", "band", "signature", "items"]
    cells = members.select("bucket", "band", "class", "component", "size", "signature", "items", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, []

        def out() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if len({g[1] for g in group}) > 1:
                ids, comps, sizes, own, band = (np.array([g[i] for g in group], np.int64) for i in range(5))
                sigs = np.frombuffer(b"".join(g[5] for g in group), np.uint32).reshape(len(group), -1)
                found = cell_links(band, ids, comps, sizes, own, sigs, [np.frombuffer(g[6], np.uint32) for g in group], s)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if c != cell:
                    yield out()
                    cell, group = c, []
                group.append(tuple(row))
        yield out()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(trimmed(run), "u long, v long").distinct()


def _blocks(s: Settings) -> Column:
    """How many blocks a bucket of n classes, with ``items`` shingles in all, is cut in."""
    return F.ceil(F.greatest(F.col("n") / s.block, 4 * F.col("items") / s.block_bytes)).cast("int")


def _mixed(members: DataFrame, s: Settings) -> DataFrame:
    """bucket, band, class, component and blocks of buckets with several components. members: bucket, band, class, component, size."""
    about = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("items"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return members.join(about.filter("lo <> hi").select("bucket", _blocks(s).alias("blocks")), "bucket")


def _narrowed(rest: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Buckets of too many blocks, cut by pairs of minima outside of the band that made them."""
    pairs = s.minima // 2
    place = lambda i: (F.col("band") * (s.rows // 2) + s.rows // 2 + i) % pairs
    wide = rest.join(reps.select("class", "signature"), "class")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(s.parts - 1)), lambda i: F.xxhash64("bucket", i, F.substr("signature", (8 * place(i) + 1).cast("int"), F.lit(8)))))
    return _mixed(wide.select(cut.alias("bucket"), "band", "class", "component", "size"), s)


def links(sketched: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Confirmed links (u, v) between classes of ``sketches``; they connect all classes that any links connect."""
    reps = keep(sketched.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r")).select("class", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.signature"), "classes")
    width = 4 * s.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", width * i + 1, width)) for i in range(s.bands)])
    rows = reps.select("class", F.col("n").alias("size"), F.posexplode(bands).alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = keep(rows.join(shared, "bucket"), "buckets")
    # the class that meets most others is likely nearest to what the others were copied from
    degree = met.groupBy("class").agg(F.sum(F.col("n") - 1).alias("degree"))
    centre = met.join(degree, "class").groupBy("bucket").agg(F.max(F.struct("degree", "class")).alias("c")).select("bucket", F.col("c.class").alias("centre"))
    star = met.join(centre, "bucket").filter("class <> centre").select(F.greatest("class", "centre").alias("u"), F.least("class", "centre").alias("v")).distinct()
    sure = keep(_confirmed(_passing(star, reps, s), reps, docs, s), "star")
    found = components(sure)
    named = met.join(found.withColumnRenamed("vertex", "class"), "class", "left").select("bucket", "band", "size", "class", F.coalesce("component", "class").alias("component"))
    rest = keep(_mixed(keep(named, "named"), s), "mixed")
    wide = rest.filter(F.col("blocks") > s.blocks)
    if not wide.isEmpty():
        rest = keep(rest.filter(F.col("blocks") <= s.blocks).unionByName(_narrowed(wide.drop("blocks"), reps, s)), "narrowed")
    sets = reps.select("class", "signature").join(_sets(rest.select("class"), reps, docs, s), "class")
    more = _confirmed(_cells(rest.join(sets, "class"), s), reps, docs, s)
    return sure.unionByName(more)


def _grouped(sketched: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, row and n_shingles of each row of ``sketches``, with first (doc_id, row): the least of its component, null where it has none."""
    groups = components(links(sketched, docs, s)).withColumnRenamed("vertex", "class")
    slim = sketched.select("doc_id", "row", "n_shingles", "class")
    least = slim.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    labelled = keep(least.join(groups, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component")), "labels")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("first"))
    # a component may have very many classes: its one row goes to each of their parts
    parts = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt")
    dealt = labelled.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(s.salts)).cast("int"))
    by_class = dealt.join(smallest.select("component", "first", parts), ["component", "salt"]).select("class", "first")
    return slim.join(by_class, "class", "left").select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of its component) and kept (whether that is its own) for each row."""
    s = settings or Settings()
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = _grouped(keep(sketches(named, s), "sketches"), named, s)
    own = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def without(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text", broadcast: int = Settings.broadcast) -> DataFrame:
    """The rows whose ``row_key`` is not among ``rows`` (one column). Up to ``broadcast`` of them, 8 bytes each, are broadcast; more are joined by shuffling.

    So a row goes by itself, whatever other rows have its id.
    """
    mark = fresh(docs.columns, "row")[0]
    gone = keep(rows.toDF(mark).distinct(), "gone")
    left = docs.withColumn(mark, row_key(key, text)).join(F.broadcast(gone) if gone.count() <= broadcast else gone, mark, "left_anti")
    return left.select(*docs.columns)


def one_of_each(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, of its smallest id, and each row without words, once; rows of null id stay."""
    s = settings or Settings()
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = keep(_grouped(keep(sketches(named, s), "sketches"), named, s), "duplicates")
    stays = F.col("doc_id").isNull() | F.col("first").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
    left = without(docs, found.filter(~stays).select("row"), key, text)
    repeated = keep(found.filter(stays & F.col("doc_id").isNotNull()).groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if repeated.isEmpty():
        return left
    mark = fresh(docs.columns, "row")[0]
    marked = left.withColumn(mark, row_key(key, text))
    same = marked.join(repeated.toDF(mark), mark, "left_semi").dropDuplicates([mark])
    return without(left, repeated, key, text).unionByName(same.select(*left.columns))
