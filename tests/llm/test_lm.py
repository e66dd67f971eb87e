"""Language-model scores: base scores by hand, each id scored once, and batches that don't matter."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers

from viewloom.llm.lm import Model, Settings, _init, classes, followers, inputs, score, score_documents, train, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = Settings(own=64, single=8, clusters=8, groups=4, near=16, passes=12, rounds=2, trainer=150, batch=64)


def test_scores(spark):
    rng = random.Random(2)
    bag = ["the", "river", "runs", "Over", "stones,", "and", "sleeps."]
    rows = [(i, " ".join(bag[(i + k + rng.randint(0, 1)) % 7] for k in range(rng.randint(0, 90)))) for i in range(160)]
    rows += [(None, "the unseen zebra"), (500, None), (501, ""), (502, "the " * 9000), (502, "the " * 9000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    training = lambda i: i is None or i % 7 != 2
    got = sorted(map(tuple, score_documents(docs, PATH, 49407, training, SMALL).collect()), key=str)
    counts = Counter()
    for i, t in rows:
        if training(i):
            counts.update([*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = [*(t or "").lower().split(), None]
        want.append((i, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4])) and g[5] < 0
    # words in their usual order are likelier than the model without training would have it
    held = [g for g in got if g[0] is not None and g[0] < 160 and g[0] % 7 == 2 and g[1] > 20]
    assert sum(g[5] for g in held) / sum(g[1] for g in held) > -1.2


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, 49407, lambda i: True, SMALL).collect() == []


def fitted(windows, steps, s=SMALL):
    counts = np.bincount(windows.ravel()[windows.ravel() < s.vocabulary], minlength=s.vocabulary)
    group = classes(np.random.default_rng(1).normal(0, 1, (s.vocabulary, 4)), counts, s)
    slot, size, mass = inputs(group, counts, s), np.bincount(group, minlength=s.classes), np.bincount(group, counts, s.classes)
    good = windows[:, 1:] < s.vocabulary
    pairs = np.zeros((s.slots, s.classes))
    np.add.at(pairs, (slot[np.minimum(windows[:, :-1], s.vocabulary)][good], group[windows[:, 1:][good]]), 1)
    model = Model(s, slot, group, np.log10((counts + 1) / (mass + size)[group]), followers(pairs, group, counts, s), _init(s))
    if steps:
        train(model, windows, tuple({k: np.zeros_like(w) for k, w in model.p.items()} for _ in range(2)), steps, 0, 0, 1)
    return model


def test_attention_learns_what_pairs_cannot_tell():
    """The id after a mark depends on the id two places before it."""
    rng = np.random.default_rng(4)
    ids = [t for a in rng.integers(0, 4, 9000) for t in (int(a), 5, 10 + int(a))]
    windows = np.array([ids[at : at + SMALL.window + 1] for at in range(0, len(ids) - SMALL.window, SMALL.window)])
    texts = [np.array(ids[at : at + 300], "<u2") for at in range(0, 3000, 300)]
    before, after = (score(fitted(windows, n), texts).sum() for n in (0, 400))
    assert after > 0.75 * before  # log probabilities: less is lost


def test_short_texts_are_learned_from():
    short = np.full((200, SMALL.window + 1), SMALL.vocabulary + 1)
    short[:, :4] = [SMALL.vocabulary, 7, 9, 7]
    model = fitted(short, 60)
    assert np.isfinite(score(model, [np.array([7, 9, 7], "<u2")])).all() and score(model, [np.array([7, 9, 7], "<u2")])[0] > score(model, [np.array([9, 9, 9], "<u2")])[0]


def test_windows_and_batches():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 50, (300, SMALL.window + 1))
    model = fitted(windows, 40)
    texts = [rng.integers(0, 60, n).astype("<u2") for n in (1, 5, 31, 32, 33, 52, 53, 500)]
    together = score(model, texts, chunk=3)
    assert np.allclose(together, [score(model, [t])[0] for t in texts], rtol=1e-4)
    # what follows doesn't matter: the sum over all continuations of a text is the text's own probability
    head = texts[2][:3]
    each = score(model, [np.append(head, i).astype("<u2") for i in range(SMALL.vocabulary)], chunk=512)
    assert abs(np.sum(10.0**each) / 10.0 ** score(model, [head])[0] - 1) < 1e-3


def test_word_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    words = [b"river", b"stones,", "naïve.".encode(), b"...", b"a.b", b"it's!", b"5.", "é,".encode(), b"end.)"]
    assert [np.frombuffer(b, "<u2").tolist() for b in word_ids(words, PATH)] == [t.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_every_window_of_every_text_is_trained_on(spark, monkeypatch):
    """Each id is a target once where there are more than ``least`` windows."""
    import viewloom.llm.lm as lm

    texts = [np.arange(n, dtype="<u2") for n in (1, 31, 32, 33, 64, 100)]
    got = lm.windows_of(texts, SMALL)
    want = []
    for t in texts:
        y = [SMALL.vocabulary, *t.tolist()]
        for at in range(0, len(t), SMALL.window):
            part = y[at : at + SMALL.window + 1]
            want.append(part + [SMALL.vocabulary + 1] * (SMALL.window + 1 - len(part)))
    assert got.tolist() == want and lm.windows_of([], SMALL).shape == (0, SMALL.window + 1)
    docs = spark.createDataFrame([(i, "the river runs over stones " * 8 + ("" if i else "zebra")) for i in range(120)], "doc_id long, text string").coalesce(1)
    small = Settings(**{**SMALL.__dict__, "least": 10, "passes": 1, "trainer": 10_000, "rounds": 3})
    seen = spark.sparkContext.accumulator(0)
    real = lm.train

    def counted(m, windows, state, steps, *rest):
        assert steps * m.s.batch >= len(windows)  # all of them
        seen.add(int((windows[:, 1:] < m.s.vocabulary).sum()))
        real(m, windows, state, steps, *rest)

    monkeypatch.setattr(lm, "train", counted)
    n = sum(len(np.frombuffer(b, "<u2")) for r in docs.collect() for b in word_ids(r["text"].encode().split(), PATH)) + 120
    score_documents(docs, PATH, 49407, lambda i: True, small).collect()
    assert seen.value == n


def test_held_words_are_not_encoded_anew(monkeypatch):
    """Where a worker's words get too many, those of the block at hand stay."""
    import viewloom.llm.lm as lm
    from viewloom.llm.worker import held

    asked, real = [], lm.encode_words
    monkeypatch.setattr(lm, "encode_words", lambda words, *rest: asked.append(sorted(words)) or real(words, *rest))
    held("another table", dict)
    first = word_ids([b"river", b"runs,", b"over"], PATH, most=5)
    again = word_ids([b"over", b"stones", b"runs,", b"river."], PATH, most=5)
    assert asked == [[b",", b"over", b"river", b"runs"], [b".", b"stones"]]
    assert again[0] == first[2] and again[2] == first[1] and again[3].startswith(first[0])


def test_gradients_are_those_of_the_score():
    """The first moment after a step, beside differences of the score itself; one window a text, some of them short."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(20, SMALL.window + 1, SMALL.batch)
    texts = [rng.integers(0, 50, n).astype("<u2") for n in sizes]
    windows = np.full((SMALL.batch, SMALL.window + 1), SMALL.vocabulary + 1)
    for row, t in zip(windows, texts, strict=True):
        row[: len(t) + 1] = [SMALL.vocabulary, *t.tolist()]
    model = fitted(windows, 60)
    weights = {k: w.copy() for k, w in model.p.items()}
    state = tuple({k: np.zeros_like(w) for k, w in model.p.items()} for _ in range(2))
    train(model, windows, state, 1, 0, 0, 1)
    model.p = weights
    for w, first in zip(weights.values(), state[0].values(), strict=True):
        at = np.argsort(-np.abs(first).ravel())[:3]
        for i in at:
            old, losses = w.ravel()[i], []
            for step in (0.01, -0.01):
                w.ravel()[i] = old + step
                losses.append(-math.log(10) * score(model, texts).sum() / sizes.sum())
            w.ravel()[i] = old
            assert abs((losses[0] - losses[1]) / 0.02 - 10 * first.ravel()[i]) < 0.05 * abs(10 * first.ravel()[i]) + 1e-5
