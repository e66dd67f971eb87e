"""Near duplicates against all pairs."""

import random

from viewloom.llm.components import components
from viewloom.llm.minhash import Settings, near_duplicates, one_of_each, without, row_key


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in keys)


def corpus(seed, n=60):
    rng = random.Random(seed)
    bag = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a  b"), (7, "b a")]
    origin = [rng.choice(bag) for _ in range(120)]
    for _ in range(n):
        copy = [rng.choice(bag) if rng.random() < 0.01 * rng.randint(0, 12) else w for w in origin]
        rows.append((len(rows) + 100, " ".join(copy)))
    for _ in range(n):
        rows.append((len(rows) + 100, " ".join(rng.choice(bag) for _ in range(rng.randint(1, 80)))))
    return rows


def test_against_all_pairs(spark):
    for words, few in ((2, {}), (5, {"block": 8}), (2, {"block": 2, "blocks": 3}), (5, {"block_bytes": 2000, "blocks": 2})):
        rows = corpus(words)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
        got = sorted(map(tuple, near_duplicates(docs, Settings(words=words, **few)).collect()))
        assert got == brute(rows, words, 80)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (None, "x y z"), (9, "X y\tz")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(docs, Settings(words=2)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (9, 2, 5, False)], key=str)


def test_one_of_each_keeps_distinct_texts_of_an_id(spark):
    rows = [(1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "k l m n o p q r s t"), (6, "k l m n o p q r s t"), (6, "K l m n o p q r s t"), (8, ""), (8, ""), (8, None), (None, "a b c d e f g h")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, rows[0][1]), (5, rows[2][1]), (8, ""), (8, None), (None, rows[0][1])], key=str)
    left = without(docs, docs.filter("doc_id = 5 AND text LIKE 'a%'").select(row_key()))
    assert left.count() == 8 and without(docs, docs.select(row_key()), broadcast=0).count() == 0


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
