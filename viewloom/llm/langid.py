"""Language identification by a byte convolutional network, trained in numpy.

Bytes are folded to classes (letters without case, white space, digits, other ASCII, each byte above 127), embedded, and
met by filters of several widths; the maximum of each filter over a fixed-length window goes through a softmax. All
windows of a text are scored, in batches, and a text's probabilities are the mean over its windows, weighted by their
bytes. As a filter's first layer is linear, scoring looks up its response to pairs of byte classes instead of
multiplying.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned. Texts of any
length are scored whole. Nothing but the text enters a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.worker import held, lean, trimmed

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4, 5)
_LETTER = re.compile(r"[^\W\d_]")


def _folding() -> np.ndarray:
    lut = np.full(256, 2, np.uint8)
    lut[[9, 10, 11, 12, 13, 32]] = 0
    lut[48:58] = 1
    for k in range(26):
        lut[65 + k] = lut[97 + k] = 3 + k
    lut[128:] = np.arange(29, 157)
    return lut


FOLD = _folding()
CLASSES = int(FOLD.max()) + 1


@dataclass(frozen=True)
class Settings:
    """``docs_a_language`` and ``windows_a_doc`` bound the labelled sample that the network is fitted on."""

    docs_a_language: int = 300
    windows_a_doc: int = 6
    embedding: int = 8
    filters: int = 8
    epochs: int = 6
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # width, embedding, filters
    bias: np.ndarray
    weights: np.ndarray

    def tables(self) -> list[tuple[list[tuple[int, np.ndarray]], int]]:
        """For each width, (offset, response to a pair of classes) and (offset, response to one), as (tables, width)."""
        out = []
        for w in self.filters:
            one = [self.embedding @ w[j] for j in range(len(w))]
            parts = [(j, (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(-1, w.shape[2]).astype(np.float32)) for j in range(0, len(w) - 1, 2)]
            if len(w) % 2:
                parts.append((-(len(w) - 1), one[-1].astype(np.float32)))
            out.append((parts, len(w)))
        return out


def windows(data: bytes) -> np.ndarray:
    """All fixed-length windows of a text's byte classes, the last one padded with white space."""
    classes = FOLD[np.frombuffer(data, np.uint8)]
    n = max(1, -(-len(classes) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(classes)] = classes
    return out.reshape(n, WINDOW)


def fit(texts: list[np.ndarray], labels: list[str], s: Settings) -> Network:
    """Train on windows (byte classes) and their labels by Adam; the order of the sample doesn't matter."""
    languages = sorted(set(labels))
    order = sorted(range(len(labels)), key=lambda i: (labels[i], texts[i].tobytes()))
    rng = np.random.default_rng(s.seed)
    x = np.stack([texts[i] for i in order]) if order else np.zeros((0, WINDOW), np.uint8)
    y = np.array([languages.index(labels[i]) for i in order], np.int64)
    p = [rng.normal(0, 0.5, (CLASSES, s.embedding))] + [rng.normal(0, 1 / np.sqrt(w * s.embedding), (w, s.embedding, s.filters)) for w in WIDTHS]
    p += [np.zeros(len(WIDTHS) * s.filters), rng.normal(0, 0.1, (len(WIDTHS) * s.filters, max(1, len(languages))))]
    p = [a.astype(np.float32) for a in p]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(np.float32) if len(y) else np.ones(1, np.float32)
    step = 0
    for _ in range(s.epochs if len(languages) > 1 else 0):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // s.batch)):
            step += 1
            rows, b = x[at].astype(np.int64), len(at)
            emb = p[0][rows]
            tops, feats = [], []
            for k, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                resp = sum(emb[:, j : j + n].reshape(-1, s.embedding) @ p[1 + k][j] for j in range(w)).reshape(b, n, s.filters)
                top = resp.argmax(1)
                tops.append(top)
                feats.append(np.take_along_axis(resp, top[:, None], 1)[:, 0])
            raw = np.concatenate(feats, 1) + p[-2]
            hidden = np.maximum(raw, 0)
            logit = hidden @ p[-1]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(b), y[at]] -= 1
            prob *= weight[y[at]][:, None] / b
            grads = [np.zeros_like(a) for a in p]
            grads[-1] = hidden.T @ prob
            back = (prob @ p[-1].T) * (raw > 0)
            grads[-2] = back.sum(0)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * s.filters : (k + 1) * s.filters]
                for j in range(w):
                    cls = np.take_along_axis(rows, tops[k] + j, 1)
                    grads[1 + k][j] = np.einsum("bfe,bf->ef", p[0][cls], g)
                    np.add.at(grads[0], cls.ravel(), (g[:, :, None] * p[1 + k][j].T[None]).reshape(-1, s.embedding))
            for a, g, m, v in zip(p, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[0], p[1:-2], p[-2], p[-1])


def probabilities(net: Network, tables: list, x: np.ndarray) -> np.ndarray:
    """Softmax outputs for a batch of windows."""
    cls = x.astype(np.int64)
    pair = cls[:, :-1] * CLASSES + cls[:, 1:]
    feats = []
    for parts, width in tables:
        n = WINDOW - width + 1
        resp = None
        for offset, table in parts:
            idx = pair[:, offset : offset + n] if offset >= 0 else cls[:, -offset : -offset + n]
            got = table.take(idx.ravel() if idx.flags.c_contiguous else np.ascontiguousarray(idx).ravel(), axis=0, mode="clip")
            resp = got if resp is None else np.add(resp, got, out=resp)
        feats.append(resp.reshape(len(x), n, -1).max(1))
    logit = np.maximum(np.concatenate(feats, 1) + net.bias, 0) @ net.weights
    prob = np.exp(logit - logit.max(1, keepdims=True))
    return prob / prob.sum(1, keepdims=True)


def learn(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Network:
    """Fit on a bounded sample of the rows that ``train`` holds for and that have a label.

    Each language gives about ``docs_a_language`` documents, by the hash of ``key``, and ``windows_a_doc`` windows spread
    evenly over each, so what reaches the driver grows with the number of labels only.
    """
    s = settings or Settings()
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    if not counts:
        return fit([], [], s)
    draw = F.pmod(F.xxhash64(F.lit(s.seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], s.docs_a_language / r["count"])]), F.col(lang))
    chosen = rows.filter(draw < F.coalesce(share, F.lit(0.0))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = windows(value.encode())
                for i in sorted({round(k) for k in np.linspace(0, len(w) - 1, s.windows_a_doc)}):
                    out.append((name, w[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "window"])

    got = chosen.mapInArrow(cut, "lang string, window binary").collect()
    return fit([np.frombuffer(r["window"], np.uint8) for r in got], [r["lang"] for r in got], s)


def predict(docs: DataFrame, net: Network, text: str = "text", *others: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``others`` (which may hold ``text``), and the language and score of each row under ``names``."""
    fields = docs.select(*others).schema
    source = lean(docs).select(F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others) if c != text])
    at = {c: i for i, c in enumerate(source.columns)}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held(("network", net.weights.tobytes()), net.tables)
        for batch in batches:
            pred, score = label(net, tables, batch.column(0).to_pylist())
            cols = [batch.column(at.get(f"c{i}", 0)) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*others, *names])

    return source.mapInArrow(trimmed(run), schema)


def label(net: Network, tables: list, texts: list[str | None], chunk: int = 2048) -> tuple[list[str], list[float]]:
    """Language and score of each text, over all its windows."""
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not net.languages:
        return pred, score
    total = np.zeros((len(texts), len(net.languages)))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if not held:
            return
        x, who = np.concatenate(held), np.concatenate(owner)
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            prob = probabilities(net, tables, part) * np.maximum(1, (part != 0).sum(1))[:, None]
            np.add.at(total, who[at : at + chunk], prob)
        held, owner, size = [], [], 0

    for i, value in enumerate(texts):
        if value is None or not _LETTER.search(value):
            continue
        w = windows(value.encode("utf-8", "replace"))
        held.append(w)
        owner.append(np.full(len(w), i))
        size += len(w)
        pred[i] = ""
        if size >= 4 * chunk:
            flush()
    flush()
    best = total.argmax(1)
    for i in range(len(texts)):
        if pred[i] == "":
            pred[i] = net.languages[best[i]]
            score[i] = float(min(1.0, total[i, best[i]] / total[i].sum()))
    return pred, score
