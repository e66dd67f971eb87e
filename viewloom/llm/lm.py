"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy, beside word frequencies.

A text's subword ids, and an end id, are scored in overlapping context windows: each window scores the ids that no
earlier window scored, with at least ``window - stride`` ids of context. What follows an id, by class of ids, is counted
over all training documents; one masked attention layer and a hidden layer learn what those counts leave open. Together
they give a distribution over groups of classes of ids, and over the classes in a group; within its class an id has its
add-one share of the counts of all training documents. Queries, keys and values are linear in the embeddings, so scoring
looks them up, and only the class distribution of an id's own group is computed.

Classes, counts and what follows an id come from all training documents, and so do the network's weights: it goes over
every id of every training document, short ones included. Blocks of documents are dealt to trainers, more of them for a
larger corpus. In each round every trainer goes over another part of its blocks' windows from the same weights, and the
weights are averaged, so training is spread over the cluster and a task holds one block's windows at a time.

Null texts are empty: one end. Repeated rows count and are scored as they come; with no training documents all counts
are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.postings import NAMES, SCHEMA, Lookup, buckets_for, dictionary, pack, postings, sum_by_document, unpack, unpack_ids
from viewloom.llm.store import keep
from viewloom.llm.subwords import encode_words
from viewloom.llm.worker import held, trimmed


@dataclass(frozen=True)
class Settings:
    """All windows are trained on, ``passes`` times if there are up to ``least``, else less often, but once; ``trainer``: windows of a trainer at least, about."""

    vocabulary: int = 49408
    window: int = 32
    stride: int = 20
    width: int = 16
    hidden: int = 24
    own: int = 1024
    single: int = 160
    clusters: int = 96
    groups: int = 16
    near: int = 256
    vector: int = 8
    prior: float = 20.0
    least: int = 12_000
    trainer: int = 12_000
    rounds: int = 3
    passes: int = 3
    batch: int = 128
    rate: float = 0.008
    seed: int = 3

    @property
    def classes(self) -> int:
        return self.single + self.clusters

    @property
    def slots(self) -> int:
        """Of inputs: the most frequent ids, classes for all others, and the begin of a text."""
        return self.own + self.classes + 1


LIMIT = np.float32(25.0)


@dataclass
class Model:
    s: Settings
    slot: np.ndarray  # of each id, for input; the last slot begins a text
    group: np.ndarray  # class of each id
    share: np.ndarray  # log10 of an id's share of its class
    after: tuple[np.ndarray, np.ndarray]  # ln of the shares of groups after each slot, and of classes in their group
    p: dict[str, np.ndarray]

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring looks up: each slot's and place's part in queries and the hidden layer (late), and in keys and values (early)."""
        p, d = self.p, self.s.width
        late = np.hstack([p["A"][:, :d] * np.float32(d**-0.5), p["R"][d + 1 :]])
        bias = np.concatenate([np.zeros(d, np.float32), p["R"][d]])
        out = {"late": p["E"] @ late, "p late": p["P"] @ late + bias, "early": p["E"] @ p["A"][:, d:], "p early": p["P"] @ p["A"][:, d:]}
        heads = _heads(p, self.s)
        return out | {"heads": heads[:, :-1], "after": self.both() + np.tile(heads[:, -1], (self.s.slots, 1))}

    def both(self) -> np.ndarray:
        """A row for each slot and group: ``after`` of the groups, then of the classes in this group."""
        return np.concatenate([np.repeat(self.after[0], self.s.groups, 0), self.after[1].reshape(-1, self.s.classes // self.s.groups)], 1)


def _init(s: Settings) -> dict[str, np.ndarray]:
    """Weights that leave the counts as they are: the last layer is zero.

    A: queries, keys and values from embeddings. R: the hidden layer from what attention gives, a one and embeddings. G and
    C: groups, and the classes of each group, from the hidden layer and a one.
    """
    rng = np.random.default_rng(s.seed)
    d, h = s.width, s.hidden
    shapes = {"E": (s.slots, d), "P": (s.window, d), "Wq": (d, d), "Wk": (d, d), "Wv": (d, d), "Wo": (d, h), "W1": (d, h), "b1": (h,), "Wg": (h, s.groups), "bg": (s.groups,), "Wc": (h, s.classes), "bc": (s.classes,)}
    scale = {"E": 0.5, "P": 0.1, "b1": 0, "Wg": 0, "bg": 0, "Wc": 0, "bc": 0}
    p = {k: (rng.normal(0, 1, v) * scale.get(k, v[0] ** -0.5)).astype(np.float32) for k, v in shapes.items()}
    inner = np.vstack([p["Wc"], p["bc"]]).reshape(h + 1, s.groups, -1).transpose(1, 0, 2)
    return {"E": p["E"], "P": p["P"], "A": np.hstack([p["Wq"], p["Wk"], p["Wv"]]), "R": np.vstack([p["Wo"], p["b1"], p["W1"]]), "G": np.vstack([p["Wg"], p["bg"]]), "C": np.ascontiguousarray(inner)}


def _heads(p: dict[str, np.ndarray], s: Settings) -> np.ndarray:
    """For each group, the weights of all groups beside those of its classes."""
    return np.concatenate([np.broadcast_to(p["G"], (s.groups, *p["G"].shape)), p["C"]], 2)


def classes(near: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """A class for each id: the most frequent ids have their own, the others are clustered by their neighbours. near: a sum of vectors of each id's neighbours."""
    order = np.argsort(-counts, kind="stable")
    group = np.zeros(s.vocabulary, np.int64)
    group[order[: s.single]] = np.arange(s.single)
    rest = order[s.single :]
    x = (near / np.maximum(1, counts)[:, None])[rest].astype(np.float32)
    weight = np.sqrt(counts[rest]) + 1e-3
    x -= np.average(x, 0, weight)
    centre = x[np.linspace(0, min(len(rest) - 1, 40 * s.clusters), s.clusters).astype(int)].copy()
    for _ in range(12):
        at = (((centre**2).sum(1))[None] - 2 * x @ centre.T).argmin(1)
        mass = np.bincount(at, weight, s.clusters)
        for j in range(x.shape[1]):
            centre[:, j] = np.where(mass > 0, np.bincount(at, weight * x[:, j], s.clusters) / np.maximum(mass, 1e-9), centre[:, j])
    group[rest] = s.single + at
    return group


def inputs(group: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """The input slot of each id, and of the begin of a text; rare ids enter by their class."""
    slot = np.append(s.own + group, s.slots - 1)
    order = np.argsort(-counts, kind="stable")[: s.own]
    slot[order] = np.arange(len(order))
    return slot


def followers(pairs: np.ndarray, group: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """ln shares of class groups after each slot, and of classes in their group, from counts of (slot, class); drawn to those of all ids by ``prior`` counts.

    Classes without ids have no share.
    """
    size = np.bincount(group, minlength=s.classes)
    mass = np.bincount(group, counts + 1, s.classes)
    p = (pairs + s.prior * mass / mass.sum()).reshape(s.slots, s.groups, -1)
    whole = p.sum(2)
    with np.errstate(divide="ignore"):
        there = size.reshape(s.groups, -1)
        by_group = np.where(there.any(1), np.log(np.maximum(whole, 1e-30) / whole.sum(1, keepdims=True)), -1e4)
        by_class = np.where(there > 0, np.log(np.maximum(p, 1e-30) / np.maximum(whole, 1e-30)[..., None]), -1e4)
    return by_group.astype(np.float32), by_class.astype(np.float32)


def _bound(t: int) -> np.ndarray:
    """What an attention logit is cut at: LIMIT, and for places that come later where exp is 0."""
    return np.where(np.tril(np.ones((t, t))), LIMIT, -200).astype(np.float32)


def _by_group(group: np.ndarray, s: Settings) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and where each group that occurs begins and ends in it."""
    ends = np.cumsum(np.bincount(group, minlength=s.groups)).tolist()
    return np.argsort(group.astype(np.uint16), kind="stable"), [(j, lo, hi) for j, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)) if lo < hi]


def train(m: Model, windows: np.ndarray, state: tuple[dict, dict], steps: int, seed: int, done: float, rounds: int) -> None:
    """Adam on the cross-entropy of the next class, with gradients written out; changes the model's weights and ``state``.

    windows: rows of window + 1 ids, vocabulary for the begin of a text and beyond for the places after its end. The steps
    go through all of them in a random order, and through them again when there are more steps. done: the rounds before
    this one.
    """
    s = m.s
    rng = np.random.default_rng((s.seed, seed))
    real = windows[:, 1:] < s.vocabulary
    x, y = m.slot[np.minimum(windows[:, :-1], s.vocabulary)], m.group[np.where(real, windows[:, 1:], 0)]
    t, d, h, each = s.window, s.width, s.hidden, s.classes // s.groups
    n = s.batch * t
    # weights, moments and gradients lie in one array each, that p and g look into
    sizes = np.cumsum([0, *(w.size for w in m.p.values())])
    flat, first, second, grad = (np.concatenate([w.ravel() for w in v.values()]) for v in (m.p, *state, m.p))
    p, g = ({k: v[lo:hi].reshape(w.shape) for (k, w), lo, hi in zip(m.p.items(), sizes, sizes[1:])} for v in (flat, grad))
    bound, after = _bound(t), m.both()
    scale = np.repeat(np.array([d**-0.5, 1, 1], np.float32), d)
    of_group, of_inner = np.arange(s.classes) // each, np.arange(s.classes) % each
    rows, one = np.arange(n), np.ones(max(n, t, each), np.float32)
    pick = rows * 2 * each
    wide, back = np.empty((2, s.batch, t, 3 * d), np.float32)
    q, k, v = wide[..., :d], wide[..., d : 2 * d], wide[..., 2 * d :]
    a, da = np.empty((2, s.batch, t, t), np.float32)
    met, hid = np.ones((n, 2 * d + 1), np.float32), np.ones((n, h + 1), np.float32)  # with ones, for biases
    mixed = met.reshape(s.batch, t, -1)[..., :d]
    z, told = np.empty((2, n, 2 * each), np.float32)
    dh, dr, r = np.empty((3, n, h), np.float32)
    dmet, de = np.empty((n, 2 * d + 1), np.float32), np.empty((n, d), np.float32)
    e, h_by = np.empty((n, d), np.float32), np.empty((n, h + 1), np.float32)
    dheads = np.empty((s.groups, h + 1, 2 * each), np.float32)
    order, used = rng.permutation(len(x)), 0
    for step in range(1, steps + 1):
        at = order[used : used + s.batch]
        used += s.batch
        while len(at) < s.batch:
            order, used = rng.permutation(len(x)), s.batch - len(at)
            at = np.concatenate([at, order[:used]])
        came, goal, good = x[at].ravel(), y[at].ravel(), real[at].ravel()
        linear = p["A"] * scale
        p["E"].take(came, axis=0, out=e, mode="clip")
        e.reshape(s.batch, -1)[...] += p["P"].ravel()
        met[:, d + 1 :] = e
        np.matmul(e, linear, out=wide.reshape(n, -1))
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        np.minimum(a, bound, out=a)
        np.exp(a, out=a)
        a *= (1 / np.maximum(a @ one[:t], np.float32(1e-30)))[..., None]
        np.matmul(a, v, out=mixed)
        np.matmul(met, p["R"], out=r)
        np.maximum(r, 0, out=hid[:, :h])
        # only the classes of the goal's own group have a part in its loss; rows are in order of their goals' groups here
        by, parts = _by_group(of_group.take(goal), s)
        goal = goal.take(by)
        group, inner, heads = of_group.take(goal), of_inner.take(goal), _heads(p, s)
        hid.take(by, axis=0, out=h_by, mode="clip")
        for j, lo, hi in parts:
            np.matmul(h_by[lo:hi], heads[j], out=z[lo:hi])
        z += after.take(came.take(by) * s.groups + group, axis=0, out=told, mode="clip")
        np.minimum(z, LIMIT, out=z)
        np.exp(z, out=z)
        weight = (good / np.float32(max(1, good.sum()))).take(by)
        halves, single = z.reshape(-1, each), z.reshape(-1)
        halves *= (weight[:, None] / np.maximum(halves @ one[:each], np.float32(1e-30)).reshape(n, 2)).reshape(-1, 1)
        single[pick + group] -= weight
        single[pick + each + inner] -= weight
        dheads[...] = 0
        for j, lo, hi in parts:
            np.matmul(h_by[lo:hi].T, z[lo:hi], out=dheads[j])
            np.matmul(z[lo:hi], heads[j, :h].T, out=dh[lo:hi])
        g["G"][...], g["C"][...] = dheads[..., :each].sum(0), dheads[..., each:]
        to = np.empty_like(by)
        to[by] = rows
        dh.take(to, axis=0, out=dr, mode="clip")
        dr *= r > 0
        np.matmul(met.T, dr, out=g["R"])
        np.matmul(dr, p["R"].T, out=dmet)
        dc = dmet.reshape(s.batch, t, -1)[..., :d]
        np.matmul(dc, v.transpose(0, 2, 1), out=da)
        da -= np.einsum("bij,bij->bi", dc, mixed)[..., None]
        da *= a
        np.matmul(da, k, out=back[..., :d])
        np.matmul(da.transpose(0, 2, 1), q, out=back[..., d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dc, out=back[..., 2 * d :])
        np.matmul(e.T, back.reshape(n, -1), out=g["A"])
        g["A"] *= scale
        np.matmul(back.reshape(n, -1), linear.T, out=de)
        de += dmet[:, d + 1 :]
        g["P"][...] = (one[: s.batch] @ de.reshape(s.batch, -1)).reshape(t, d)
        for j, w in enumerate(de.T):
            g["E"][:, j] = np.bincount(came, w, s.slots)
        past = (done + step / steps) / rounds
        rate = s.rate * min(1.0, (done * steps + step) / 30) * (1 - 0.9 * past)
        first += np.float32(0.1) * (grad - first)
        second += np.float32(0.01) * (grad * grad - second)
        flat -= np.float32(rate) * first / (np.sqrt(second) + np.float32(1e-6))
    for held_by, new in ((m.p, flat), (state[0], first), (state[1], second)):
        for w, lo, hi in zip(held_by.values(), sizes, sizes[1:]):
            w[...] = new[lo:hi].reshape(w.shape)


def _window_scores(m: Model, tables: dict, x: np.ndarray, y: np.ndarray, skip: int) -> np.ndarray:
    """log10 of the class probabilities of the targets after the first ``skip`` positions. x: slots, y: classes, by window."""
    s = m.s
    t, d, n, each = s.window, s.width, len(x), s.classes // s.groups
    came, goal = x[:, skip:].ravel(), y.ravel()
    late, early = tables["late"].take(came, axis=0).reshape(n, -1), tables["early"].take(x.ravel(), axis=0).reshape(n, -1)
    late += tables["p late"][skip:].ravel()
    early += tables["p early"].ravel()
    late, early = late.reshape(n, t - skip, -1), early.reshape(n, t, -1)
    a = late[..., :d] @ early[..., :d].transpose(0, 2, 1)
    np.minimum(a, _bound(t)[skip:], out=a)
    np.exp(a, out=a)
    c = a @ early[..., d:]
    c /= np.maximum(a @ np.ones(t, np.float32), np.float32(1e-30))[..., None]
    r = c.reshape(-1, d) @ m.p["R"][:d]
    r += late[..., d:].reshape(r.shape)
    np.maximum(r, 0, out=r)
    group = goal // each
    by, parts = _by_group(group, s)
    group, r = group.take(by), r.take(by, axis=0)
    z = np.empty((len(by), 2 * each), np.float32)
    for j, lo, hi in parts:
        np.matmul(r[lo:hi], tables["heads"][j], out=z[lo:hi])
    z += tables["after"].take(came.take(by) * s.groups + group, axis=0)
    np.minimum(z, LIMIT, out=z)
    pick = np.arange(0, z.size, 2 * each)
    mine = z.ravel()[pick + group] + z.ravel()[pick + each + goal.take(by) % each]
    np.exp(z, out=z)
    mine -= np.log(z.reshape(-1, each) @ np.ones(each, np.float32)).reshape(-1, 2).sum(1)
    out = np.empty_like(mine)
    out[by] = mine
    return (out * np.float32(1 / np.log(10))).reshape(n, t - skip)


def score(m: Model, texts: list[np.ndarray], chunk: int = 256) -> np.ndarray:
    """log10 probability of each text (its ids, the end id included); each id is scored once."""
    s = m.s
    tables = m.tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes):
        return np.zeros(0)
    ids = np.concatenate(texts).astype(np.int64)
    ends = np.cumsum(sizes)
    total = np.add.reduceat(m.share[ids], ends - sizes) if (sizes > 0).all() else np.array([m.share[t.astype(np.int64)].sum() for t in texts])
    group = m.group[ids]
    inputs = np.empty(len(ids), np.int64)
    inputs[1:] = m.slot[ids[:-1]]
    inputs[(ends - sizes)[sizes > 0]] = m.slot[s.vocabulary]
    lag = s.window - s.stride
    more = -(-np.maximum(0, sizes - s.window) // s.stride)
    later = np.repeat(np.arange(len(texts)), more)
    nth = np.arange(len(later)) - np.repeat(np.cumsum(more) - more, more) + 1
    for owner, begin, skip in ((np.arange(len(texts)), np.zeros(len(texts), np.int64), 0), (later, nth * s.stride, lag)):
        for at in range(0, len(owner), chunk):
            who, start = owner[at : at + chunk], begin[at : at + chunk]
            place = start[:, None] + np.arange(s.window)
            valid = place < sizes[who][:, None]
            place = np.minimum(place, sizes[who][:, None] - 1) + (ends - sizes)[who][:, None]
            got = _window_scores(m, tables, inputs[place], group[place[:, skip:]], skip)
            total += np.bincount(who, (got * valid[:, skip:]).sum(1, dtype=np.float64), len(texts))
    return total


def marks(training: Callable[[int | None], bool], ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.array([training(None if n else int(i)) for i, n in zip(ids, nulls, strict=True)], bool)


#: Punctuation that the tokenizer splits from a letter before it.
_TAIL = b".,;:!?#$%&*)]"


def word_ids(words: list[bytes], path: str, most: int = 300_000) -> list[bytes]:
    """Subword ids of each lowered word, as unsigned 16-bit bytes. A worker holds a bounded number of words' ids.

    Punctuation after a letter is looked up apart, as the tokenizer splits it off.
    """
    ends = {w: (c, w[len(c) :]) for w in words if w[-1] in _TAIL and (c := w.rstrip(_TAIL))[-1:].isalpha()}
    wanted = {*words}.difference(ends).union(*zip(*ends.values()))
    known = held(("word ids", path), dict)
    new = [w for w in wanted if w not in known]
    if len(known) + len(new) > most:
        stay = {w: known[w] for w in wanted if w in known}
        known.clear()
        known.update(stay)
    known.update(zip(new, encode_words(new, path, "<u2"), strict=True))
    return [known[ends[w][0]] + known[ends[w][1]] if w in ends else known[w] for w in words]


def _texts(extra: bytes, facts: np.ndarray, end_id: int) -> list[np.ndarray]:
    """The ids of each document of a block, with the end id."""
    raw = np.frombuffer(unpack(extra), "<u2")
    ends = np.cumsum(facts[:, 1].astype(np.int64) // 2)
    return np.split(np.insert(raw, ends, end_id), (ends + np.arange(1, len(ends) + 1))[:-1])


class _Counts(Lookup):
    """log10(c + 1), and whether c > 0."""

    columns = 2

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def begin(self) -> None:
        self.known = {}

    def learn(self, terms: list[bytes], counts: np.ndarray) -> None:
        self.known = dict(zip(terms, counts.tolist(), strict=True))

    def weights(self, terms: list[bytes]) -> np.ndarray:
        c = np.array([self.known.get(t, 0) for t in terms], np.float64)
        return np.stack([np.log10(c + 1), c > 0])


def _training_texts(batches: Iterator[pa.RecordBatch], training: Callable[[int | None], bool], end_id: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of each block of documents: the ids and the texts of those that are learned from."""
    for batch in batches:
        for extra, posts, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            values, nulls = unpack_ids(ids)
            mark = marks(training, values, nulls)
            texts = _texts(extra, np.frombuffer(unpack(posts)).reshape(len(mark), -1), end_id)
            yield values[mark], [t for t, m in zip(texts, mark, strict=True) if m]


def _summed(rows: DataFrame, kind: str = "<f8", parts: int = 16) -> np.ndarray | None:
    """The sum of arrays, one a row (``data``), of equal size: in ``parts`` tasks, then on the driver, so nothing there grows with the rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), kind)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], ["data"])

    got = [np.frombuffer(r["data"], kind) for r in rows.repartition(parts).mapInArrow(add, "data binary").collect()]
    return sum(got) if got else None


def _array(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["data"])


def _with_ends(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, and the id before each: ``begin`` before a text's first."""
    ids = np.concatenate(texts).astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum([0, *map(len, texts[:-1])])] = begin
    return ids, before


def windows_of(texts: list[np.ndarray], s: Settings) -> np.ndarray:
    """All windows of some texts, one after the other: rows of window + 1 ids, as ``train`` takes them."""
    if not texts:
        return np.zeros((0, s.window + 1), "<u2")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.insert(np.concatenate(texts), np.cumsum(sizes) - sizes, s.vocabulary)
    n = -(-sizes // s.window)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = (np.repeat(starts, n) + at * s.window).astype(np.int32)[:, None] + np.arange(s.window + 1, dtype=np.int32)
    past = place > np.repeat(starts + sizes, n).astype(np.int32)[:, None]
    np.minimum(place, len(ids) - 1, out=place)
    out = ids.take(place)
    out[past] = s.vocabulary + 1
    return out


def learn(about: DataFrame, end_id: int, training: Callable[[int | None], bool], s: Settings) -> tuple[Model, int]:
    """The model, and how many documents were learned from. about: counts, posts and ids of blocks of documents."""
    about = about.select("counts", "posts", "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.vocabulary + 2)  # then documents, and windows
        for _, texts in _training_texts(batches, training, end_id):
            if texts:
                total[:-2] += np.bincount(np.concatenate(texts), minlength=s.vocabulary)
                total[-2:] += len(texts), sum(-(-len(t) // s.window) for t in texts)
        yield _array(total)

    got = _summed(about.mapInArrow(trimmed(count), "data binary"))
    got = np.zeros(s.vocabulary + 2) if got is None else got
    counts, trained, n_windows = got[:-2].astype(np.int64), int(got[-2]), int(got[-1])
    order = np.argsort(-counts, kind="stable")[: s.near]
    rank = np.full(s.vocabulary + 1, s.near)
    rank[order] = np.arange(len(order))
    rank[s.vocabulary] = s.near + 1
    vectors = np.random.default_rng(s.seed).normal(0, 1, (2, s.near + 2, s.vector)).astype(np.float32)
    often = np.append(counts[order], [max(1, counts.sum() - counts[order].sum()), max(1, trained)]) + 1.0
    vectors *= np.sqrt(often.mean() / often)[None, :, None].astype(np.float32)
    vectors = np.ascontiguousarray(vectors.transpose(0, 2, 1), np.float64)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.vector, s.vocabulary))
        for _, texts in _training_texts(batches, training, end_id):
            if texts:
                ids, before = _with_ends(texts, s.vocabulary)
                after = np.append(np.where(before[1:] == s.vocabulary, s.vocabulary, ids[1:]), s.vocabulary)
                rank_before, rank_after = rank.take(before), rank.take(after)
                for j in range(s.vector):
                    x = vectors[0, j].take(rank_before)
                    x += vectors[1, j].take(rank_after)
                    total[j] += np.bincount(ids, x, s.vocabulary)
        yield _array(total)

    near = _summed(about.mapInArrow(trimmed(neighbours), "data binary"))
    near = np.zeros((s.vocabulary, s.vector)) if near is None else near.reshape(s.vector, s.vocabulary).T
    group = classes(near, counts, s)
    slot = inputs(group, counts, s)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.slots * s.classes)
        for _, texts in _training_texts(batches, training, end_id):
            if texts:
                ids, before = _with_ends(texts, s.vocabulary)
                total += np.bincount(slot[before] * s.classes + group[ids], minlength=len(total))
        yield _array(total)

    pairs = _summed(about.mapInArrow(trimmed(follow), "data binary"))
    pairs = np.zeros((s.slots, s.classes)) if pairs is None else pairs.reshape(s.slots, s.classes)
    size, mass = np.bincount(group, minlength=s.classes), np.bincount(group, counts, s.classes)
    share = np.log10((counts + 1) / (mass + size)[group])
    model = Model(s, slot, group, share, followers(pairs, group, counts, s), _init(s))
    passes = min(s.passes, max(1, round(s.passes * s.least / max(1, n_windows))))
    blocks = about.coalesce(max(1, round(n_windows / s.trainer)))
    names = list(model.p)
    state = tuple({k: np.zeros_like(w) for k, w in model.p.items()} for _ in range(2))
    for done in range(s.rounds):

        def fit(batches: Iterator[pa.RecordBatch], done: int = done) -> Iterator[pa.RecordBatch]:
            mine = Model(s, slot, group, share, model.after, {k: model.p[k].copy() for k in names})
            moments = tuple({k: x[k].copy() for k in names} for x in state)
            seed, total = (done << 40) + (TaskContext.get().partitionId() << 20), 0
            for _, texts in _training_texts(batches, training, end_id):
                windows = windows_of(texts, s)
                # a pass takes each window in one of the rounds
                seen = np.concatenate([np.arange((done + i) % s.rounds, len(windows), s.rounds) for i in range(passes)])
                if len(seen):
                    train(mine, windows[seen].astype(np.int64), moments, -(-len(seen) // s.batch), seed, done, s.rounds)
                    seed, total = seed + 1, total + len(seen)
            if total:
                yield _array(np.append(np.concatenate([x[k].ravel() for x in (mine.p, *moments) for k in names]) * float(total), total))

        met = _summed(blocks.mapInArrow(trimmed(fit), "data binary"))
        if met is None:
            continue
        at, flat = 0, (met[:-1] / met[-1]).astype(np.float32)
        for x in (model.p, *state):
            for k in names:
                x[k] = flat[at : at + x[k].size].reshape(x[k].shape)
                at += x[k].size
    return model, trained


def score_documents(docs: DataFrame, path: str, end_id: int, training: Callable[[int | None], bool], settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row. training: whether a document of this id is learned from."""
    s = settings or Settings()

    def ids_of(found: list[bytes]) -> list[bytes]:
        return word_ids(found, path)

    def words(value: str) -> tuple[list, tuple]:
        found = value.encode().lower().split()
        return found, (len(found),)

    kept = keep(postings(docs, words, buckets_for(docs), None, lambda ids: [training(i) for i in ids], key, text, ids_of), "words")
    about = kept.filter("terms IS NULL")
    model, trained = learn(about, end_id, training, s)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                n = len(unpack_ids(r["ids"])[0])
                facts = np.frombuffer(unpack(r["posts"])).reshape(n, -1)
                r["posts"] = pack(np.column_stack([facts, score(model, _texts(r["counts"], facts, end_id))]).tobytes())
                r["counts"] = None
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    scored = about.select(*NAMES).mapInArrow(trimmed(apply), SCHEMA)
    known = keep(dictionary(kept), "counts")
    sums = known.agg(F.sum("n_terms"), F.sum("total")).first()
    n, v = (sums[1] or 0) + trained, (sums[0] or 0) + (trained > 0)

    def finish(total: np.ndarray, facts: np.ndarray) -> list[np.ndarray]:
        tokens = facts[:, 0].astype(np.int64) + 1
        base = total[0] + np.log10(trained + 1) - tokens * np.log10(n + v + 1)
        return [tokens, np.rint(total[1]).astype(np.int64) + (trained > 0), np.full(len(tokens), n, np.int64), base, facts[:, -1]]

    rows = kept.filter("terms IS NOT NULL").unionByName(scored)
    return sum_by_document(rows, _Counts, finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double", known.select("bucket", "terms", "counts"))
