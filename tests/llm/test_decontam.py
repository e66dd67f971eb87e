"""Decontamination: verbatim, re-parameterised and clean texts."""

import random

from viewloom.llm.decontam import canonical, consistent_runs, contaminated

ITEM = "Alice drove from Boston at 60 km per hour for 3 hours and then Alice walked home, how many km did Alice travel before she met Carol near the old river bridge"


def test_cases(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Quis", "nulla."]) for _ in range(n))
    other = ITEM.replace("Alice", "Bob").replace("60", "75").replace("3 hours", "12 minutes").replace("Carol", "Dave").replace("Boston", "Denver")
    broken = ITEM.replace("then Alice", "then Bob").replace("did Alice", "did Erin")
    texts = [f"{noise(50)} {ITEM}. {noise(50)}", f"{noise(9)}\n{other}\n{noise(3000)}", f"{noise(20)} {broken}", noise(400), None, "", " ".join(ITEM.split()[:9]), ITEM.upper(), f"{ITEM} {noise(5)} {ITEM}", "one two three four five six seven", "one two three four five six seven", f"{noise(4)}, {ITEM}"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, "12 13 14 15 16 17 18 19 20"), (11, "the small cat sat on mats")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.verbatim, r.run_words) for r in contaminated(docs, items).collect()}
    # of a text whose names are mixed up the consistent part counts
    assert {k[0] for k in got} == {0, 1, 2, 8, 11} and {k[1] for k in got} == {7}
    assert got[0, 7][0] and not got[1, 7][0] and got[0, 7][1] >= 20 and got[2, 7][1] < got[1, 7][1]
    assert contaminated(docs, items.limit(0)).collect() == [] and contaminated(docs.limit(0), items).collect() == []
    small = spark.createDataFrame([(1, "He said so. The small cat sat, on mats."), (2, "the small cat sat on")], "doc_id long, text string")
    assert [r.doc_id for r in contaminated(small, items).collect()] == [1]


def test_canonical():
    template, at, words = canonical("We met Bob. He has 3,000 kg -- of $5 tin")
    same, *_ = canonical("We met Eve. He has 12 km of 7.5 tin")
    assert template.tolist() == same.tolist() and [words[i] for i in at.tolist()] == [b"We", b"met", b"Bob.", b"He", b"has", b"3,000", b"kg", b"of", b"$5", b"tin"]


def test_runs():
    item = {1: ("#", "3"), 5: ("#", "3"), 9: ("@", "ann")}
    assert consistent_runs([0, 1, 2, 3], 8, {11: ("#", "4"), 15: ("#", "4"), 19: ("@", "bob")}, item, 10) == [(0, 11)]
    assert consistent_runs([0, 1], 8, {11: ("#", "4"), 15: ("#", "5")}, item, 10) == []
    assert consistent_runs([0, 1, 5, 6], 4, {}, {}, 0) == [(0, 5), (5, 5)]


DENSE = {
    20: "A train leaves Boston at 9:30 and travels 120 miles at 60 mph. Another leaves Denver at 10:15 and travels 200 miles at 80 mph. Which arrives first?",
    21: "Name them: Paris, London, Rome, Berlin, Madrid, Vienna, Lisbon, Dublin, Athens, Oslo, Prague, Warsaw",
    22: "Compute 12 + 45 + 78 + 3 + 99 + 4",
    23: "Der Zug fährt vom Bahnhof in Köln nach Hamburg, und die Fahrt dauert 4 Stunden und 20 Minuten mit Halt in Bremen und Münster",
}


def test_dense_items(spark):
    noise = "lorem ipsum dolor sit amet quis nulla"
    rows = [(i, f"{noise} {t} {noise}") for i, t in DENSE.items()]
    # other values: where enough of the words are literal the item is found, else it is another text
    rows += [(120, f"{noise}. {DENSE[20]}".replace("Boston", "Austin").replace("Denver", "Chicago").replace("120", "130").replace("200", "210").replace("9:30", "7:45").replace("10:15", "8:05")), (121, "see Rome, Oslo, Paris, Bern, Riga, Kiev, Minsk, Sofia, London, Prague, Madrid, Dublin, Athens"), (122, "Compute 11 + 46 + 79 + 2 + 98 + 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(list(DENSE.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in contaminated(docs, items).collect()}
    assert got == {**{(i, i): True for i in DENSE}, (120, 20): False}


def test_runs_go_on_over_windows_without_hashes():
    assert consistent_runs([0, 3, 9], 8, {}, {}, 0) == [(0, 17)]


def test_values_of_other_lengths(spark):
    item = "my old friend went by train from New York in may and paid twenty five coins for the long and slow ride home"
    other = item.replace("New York", "Boston").replace("twenty five", "7")
    third = item.replace("New York", "San Juan Capistrano").replace("twenty five", "two hundred twelve")
    docs = spark.createDataFrame([(1, f"lorem ipsum. {other} dolor sit"), (2, f"lorem ipsum. {third} dolor sit"), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.verbatim, r.run_words) for r in contaminated(docs, items).collect()}
    assert got == {1: (False, 23), 2: (False, 23), 3: (True, 23)}


def test_short_and_number_heavy_items_are_found_as_they_stand(spark):
    items = ["What is 345 times 17 ?", "2 + 2 = 4", "12 + 13 = 25 and 14 + 15 = 29 16 + 17 = 33", "Paris", "", "x ="]
    docs = [f"some words before {items[0].upper()} and after", "so 2 + 2 = 4 holds", "so 2 + 2 = 5 or 2 2 4", f"sums: {items[2]} end", "paris", "Paris is a town", "a x = b", "x =", None]
    got = contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 0), (1, 1), (3, 2), (4, 3), (7, 5)]


def test_against_all_pairs(spark):
    """Verbatim passages: documents hold an item if they share 13 words, a whole shorter item, or half its windows of 8 words in a row."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5)) + "q"
    items = [[word() for _ in range(rng.randint(5, 40))] for _ in range(25)]
    docs = []
    for _ in range(150):
        doc = [word() for _ in range(rng.randint(0, 30))]
        for item in rng.sample(items, rng.randint(0, 2)):
            begin = rng.randrange(len(item))
            doc += [*item[begin : begin + rng.randint(1, 20)], *[word() for _ in range(rng.randint(1, 10))]]
        docs.append(doc)

    def longest(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            run, width = longest(doc, item), min(8, len(item))
            if run >= min(13, len(item)) or (run >= width and run - width + 1 >= 0.5 * (len(item) - width + 1)):
                want.add((d, i))
    got = contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20
