"""The pipeline's stages on made-up documents, and its result against the library's ids."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from viewloom.llm.store import keep

SECRET = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def make(spark, folder):
    rng = random.Random(9)
    bags = {"en": "the of and river stone house walk night cold bring".split(), "de": "der und nicht haus straße über schön gehen kalt nacht".split()}
    say = lambda lang, n: " ".join(rng.choice(bags[lang]) + rng.choice(["", "en", "er", "s", "lich"]) for _ in range(n))
    rows = [(i, say(lang, rng.randint(30, 120)), lang, "s") for i in range(120) for lang in [("en", "de")[i % 2]]]
    item = say("en", 30)
    rows += [(200, rows[4][1], "en", "s"), (201, rows[6][1] + " more", "en", "s"), (202, f"{say('en', 40)} {item} {say('en', 40)}", "en", "s"), (203, f"{say('en', 40)} token = \"{SECRET}\"", "en", "s"), (204, None, "en", "s"), (205, "12 34", "de", "s"), (7, rows[7][1], "de", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages(spark, tmp_path):
    texts = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = keep(stage(spark, docs, str(tmp_path)), "stage")
        assert new.columns == docs.columns
        kept.append({r.doc_id: r for r in new.collect()})
        docs = new
    assert set(texts) - set(kept[0]) == {204, 205}
    assert set(kept[0]) - set(kept[1]) == {200, 201} and docs.count() == len(kept[3])
    assert set(kept[1]) - set(kept[2]) == {202}
    assert set(kept[2]) == set(kept[3])
    changed = {i for i, r in kept[3].items() if r.text != texts[i]}
    assert changed == {203} and SECRET not in kept[3][203].text and kept[3][203].n_chars == len(kept[3][203].text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[3].values())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == want and {r.doc_id for r in rows} == set(kept[3])
    filled = np.bincount([r.sequence_id for r in rows], [r.length for r in rows])
    assert filled.max() <= 4096


def test_clashing_columns_repeated_and_null_ids(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first, second, third = ("the river stones walked nightly and bringen cold houses over walks", "and the cold house brings of stones the walken nights rivers", "of walklich night the rivers cold and stone houses bringer the")
    more = spark.createDataFrame([(7, first, "en", "s", 1), (None, second, "en", "s", 3), (None, None, "en", "s", None), (202, third, "en", "s", 5)], docs.schema)
    extra = ("score", "lang_pred", "spans", "__was", "__base", "row", "_row", "class", "merged", "bucket", "c1")
    wide = docs.unionByName(more).select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = keep(stage(spark, wide, str(tmp_path)), "stage")
        assert wide.columns == [*docs.columns, *extra], name
    assert [tuple(r) for r in wide.select(*extra).distinct().collect()] == [tuple(range(len(extra)))]
    got = {(r.doc_id, r.text) for r in wide.collect()}
    # another text of the same id is another document, whether that one is a copy or contaminated
    assert (7, first) in got and (202, third) in got and (None, second) in got
    assert len([i for i, _ in got if i == 7]) == 2 and len([i for i, _ in got if i == 202]) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).filter("doc_id IS NULL").count() == 1


def test_empty_table(spark, tmp_path):
    make(spark, tmp_path / "full")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
