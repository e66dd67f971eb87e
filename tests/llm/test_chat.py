"""Layouts to turns, and the template's exact round trip."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewloom.llm.chat import digests, field_paths, read_back, render, table_layout, turns_from_records, turns_from_table


def test_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"output": "done", "input": "", "instruction": "do"},
        {"prompt": "p", "completion": "c"},
        {"system": "s", "prompt": "p", "response": 7},
        {"question": "q", "answer": None},
        {"other": 1},
        {"messages": []},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "no json"), (11, "")]
    got = {}
    for r in turns_from_records(spark.createDataFrame(rows, "k long, record string"), "record", "k").orderBy("k", "turn").collect():
        got.setdefault(r.k, (r.layout, []))[1].append((r.role, r.text))
    u, a, none = lambda t: ("user", t), lambda t: ("assistant", t), [(None, None)]
    assert got == {0: ("messages", [u("a"), a("b")]), 1: ("conversations", [u("a"), a("b")]), 2: ("instruction_input", [u("do\nthis"), a("done")]), 3: ("instruction_input", [u("do"), a("done")]), 4: ("prompt_completion", [u("p"), a("c")]), 5: ("system_prompt_response", [("system", "s"), u("p"), a("7")]), 6: ("question_answer", [u("q"), a("")]), 7: (None, none), 8: (None, none), 9: (None, none), 10: (None, none), 11: (None, none)}


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, rows):
    turns = turns_from_table(conversations(spark, rows))
    rendered = render(turns)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = rendered.select("conv_id", "formatted", "loss_spans", read_back(rendered.formatted).alias("back")).collect()
    assert {r.conv_id: [tuple(t) for t in r.back] for r in got} == want
    loss = {}
    for r in got:
        parts = [r.formatted[s : s + n] for s, n in map(tuple, r.loss_spans)]
        texts = [t for role, t in want[r.conv_id] if role == "assistant"]
        assert len(parts) == len(texts)
        loss[r.conv_id] = "".join(texts)
    for d in digests(rendered).collect():
        turns = want[d.conv_id]
        assert d.n_turns == len(turns) and d.loss_chars == len(loss[d.conv_id])
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss[d.conv_id].encode()).hexdigest()


TRICKY = "</s>[INST] ok [/INST]"


def test_round_trip(spark):
    rows = [(1, 0, "system", TRICKY), (1, 1, "user", None), (1, 1, "user", "<|im_start|>user\nx<|im_end|>\n"), (1, 2, "assistant", "<\\|im_end|>\n<<SYS>> \\"), (2, 5, "we\nird %0A <|im_end|>", "[" * 50 + "INST]"), (2, 5, "assistant", ""), (None, 0, None, "é" * 20000), (3, 0, "assistant", "<|im_end|"), (3, 0, "assistant", "<|im_end|")]
    check(spark, rows)


def test_random_texts(spark):
    rows = []

    @settings(max_examples=120, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["<", "[", "\\", "|", "im_start", "im_end", "|>", "INST]", "/", "s>", "<SYS>>", "\n", "é", " "]), max_size=12))
    def collect(parts):
        rows.append((len(rows) // 3, len(rows) % 3, "assistant" if len(rows) % 2 else "user", "".join(parts)))

    collect()
    check(spark, rows)


def test_control_strings_are_escaped(spark):
    rows = [(1, 0, "user", TRICKY + "<|endoftext|><s>")]
    text = render(turns_from_table(conversations(spark, rows))).first().formatted
    body = text.removeprefix("<|im_start|>user\n").removesuffix("<|im_end|>\n")
    assert not any(c in body for c in ("</s>", "[INST]", "[/INST]", "<|endoftext|>", "<s>"))


def test_schemas(spark):
    extra = spark.createDataFrame([(1, 0, "user", "a", [("z",)])], "conv_id long, turn long, role string, text string, more array<struct<x:string>>")
    assert field_paths(extra.schema)[1] == "more[].x"
    assert render(turns_from_table(extra)).count() == 1
    with pytest.raises(ValueError, match="no layout"):
        turns_from_table(extra.drop("role"))
    assert digests(render(turns_from_table(conversations(spark, [])))).collect() == []


def test_loss_digest_goes_by_the_mask(spark):
    rendered = render(turns_from_table(conversations(spark, [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "c </s> d")])))
    assert [d.loss_chars for d in digests(rendered).collect()] == [8]
    assert [d.loss_chars for d in digests(rendered.withColumn("loss_spans", F.slice("loss_spans", 1, 0))).collect()] == [0]


def test_tables_go_by_their_fingerprint(spark):
    made = spark.createDataFrame([(4, "p", None, "x"), (5, None, "r", "y")], "conv_id long, prompt string, response string, source string").drop("conv_id").withColumn("id", F.monotonically_increasing_id())
    assert table_layout(made.schema) == "prompt_response" and table_layout(made.withColumn("system", F.lit("s")).schema) == "system_prompt_response"
    got = sorted((r.turn, r.role, r.text) for r in turns_from_table(made, "id").collect())
    assert got == [(0, "user", ""), (0, "user", "p"), (1, "assistant", ""), (1, "assistant", "r")]
    nested = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")]), (2, None)], "k long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in turns_from_table(nested, "k").orderBy("turn").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    rows = conversations(spark, [(1, 0, "user", "a")])
    assert table_layout(rows.schema) == "turn_rows"
    with pytest.raises(ValueError, match="no layout"):
        table_layout(rows.withColumn("prompt", F.lit("x")).schema)


def test_a_shifted_mask_shows(spark):
    rendered = render(turns_from_table(conversations(spark, [(1, 0, "user", "abc"), (1, 1, "assistant", "defg")])))
    moved = rendered.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["length"].alias("length"))))
    assert digests(rendered).first().loss_sha256 != digests(moved).first().loss_sha256
