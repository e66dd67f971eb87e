"""Language identification: held-out accuracy, and odd texts."""

import random

from pyspark.sql import functions as F

from viewloom.llm.langid import Settings, learn, predict

SYLLABLES = {"xx": "ka lo mi ten sur".split(), "yy": "schu gen ber ach ung".split(), "zz": "ção ñan léa mête ouí".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 200)), lang) for i in range(600)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !? 34", "yy"), (1003, text(rng, "yy", 30000), None), (1004, "ka", None), (1004, "ka", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = learn(docs, F.col("doc_id") % 4 != 2, settings=Settings(epochs=6))
    got = [tuple(r) for r in predict(docs, net, "text", "doc_id", "text").collect()]
    by_id = {g[0]: g for g in got}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] < 1000]
    assert sum(by_id[i][2] == lang for i, _, lang in held) / len(held) > 0.97
    assert all(by_id[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003][2] == "yy" and len(got) == len(rows) and by_id[1003][1] == rows[603][1]
    assert all(0 <= g[3] <= 1 for g in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "ka lo", None)], "doc_id long, text string, lang string")
    assert predict(docs, learn(docs, F.lit(True)), "text", "doc_id").first().lang_pred == "und"
    assert predict(docs.limit(0), learn(docs, F.lit(True)), "text", "doc_id").collect() == []
