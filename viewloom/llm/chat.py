"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, rendered by a reversible template.

Main path: DataFrame functions only.

A layout is named by the hash of its sorted nested field paths. ``LAYOUTS`` declares, for each known layout, how its
fields become turns. A table's layout is chosen by the hash of those of its paths that any layout knows, so other columns
don't matter; JSON records are fingerprinted row by row, so that one column may mix layouts. Records that match no layout,
and text that is no JSON, get no turns and a null layout; a table that matches none is an error.

Defined results: null roles and texts are empty; repeated rows are repeated turns; rows with a null conversation are one
conversation.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout name -> (nested shape, turns). A turn is ("each", array path, role field, text field), (role, text fields), or ("row",
#: conversation, turn, role and text field) where each row is a turn.
LAYOUTS: dict[str, tuple[dict, tuple]] = {
    "messages": ({"messages": [{"content": None, "role": None}]}, (("each", "messages", "role", "content"),)),
    "conversations": ({"conversations": [{"from": None, "value": None}]}, (("each", "conversations", "from", "value"),)),
    "system_conversations": ({"conversations": [{"from": None, "value": None}], "system": None}, (("system", ("system",)), ("each", "conversations", "from", "value"))),
    "instruction": ({"instruction": None, "output": None}, (("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": ({"input": None, "instruction": None, "output": None}, (("user", ("instruction", "input")), ("assistant", ("output",)))),
    "prompt_response": ({"prompt": None, "response": None}, (("user", ("prompt",)), ("assistant", ("response",)))),
    "prompt_completion": ({"completion": None, "prompt": None}, (("user", ("prompt",)), ("assistant", ("completion",)))),
    "system_prompt_response": ({"prompt": None, "response": None, "system": None}, (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    "turn_rows": ({"conv_id": None, "role": None, "text": None, "turn": None}, (("row", "conv_id", "turn", "role", "text"),)),
    "question_answer": ({"answer": None, "question": None}, (("user", ("question",)), ("assistant", ("answer",)))),
}
#: Roles by other names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A control string: its first character, escapes so far, its rest.
CONTROL = r"(/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]{1,32}\|>)"
ESCAPE = (r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a Spark type; arrays add ``[]``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in (field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) or [f"{prefix}.{f.name}" if prefix else f.name]))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]") or [f"{prefix}[]"]
    return [prefix] if prefix else []


def shape_paths(shape: object, prefix: str = "") -> list[str]:
    """The nested field paths of a declared shape (dicts, one-element lists, None for a scalar)."""
    if isinstance(shape, dict):
        return sorted(p for k, v in shape.items() for p in shape_paths(v, f"{prefix}.{k}" if prefix else k))
    if isinstance(shape, list):
        return shape_paths(shape[0], f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """The hash that names a layout."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _variant_shape(shape: object) -> str:
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_variant_shape(v)}" for k, v in sorted(shape.items())) + ">"
    if isinstance(shape, list):
        return f"ARRAY<{_variant_shape(shape[0])}>"
    return ""


def record_fingerprint(record: Column) -> Column:
    """The hash of a JSON record's nested field paths, whatever the types of its scalars; null if it is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(shape, r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)", ""), 256)


def _role(role: Column) -> Column:
    lowered = F.coalesce(role, F.lit(""))
    return reduce(lambda out, pair: F.when(lowered == pair[0], F.lit(pair[1])).otherwise(out), ROLES.items(), lowered)


def _turn(role: str, text: str):
    return lambda x: F.struct(_role(x[role].cast("string")).alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))


def _record_turns(record: Column, turns: tuple) -> Column:
    parts = []
    for turn in turns:
        if turn[0] == "each":
            _, path, role, text = turn
            items = F.from_json(F.get_json_object(record, f"$.{path}"), f"array<struct<`{role}`: string, `{text}`: string>>")
            parts.append(F.transform(F.coalesce(items, F.array()), _turn(role, text)))
        else:
            role, fields = turn
            texts = F.array(*[F.coalesce(F.get_json_object(record, f"$.{f}"), F.lit("")) for f in fields])
            parts.append(F.array(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(texts, lambda x: x != ""), "\n").alias("text"))))
    return F.concat(*parts)


def turns_from_records(df: DataFrame, record: str, *keys: str) -> DataFrame:
    """Canonical turns of a column of JSON records: ``keys``, layout, turn, role, text; one row per turn.

    Null, empty and unknown records, and records without turns, give one row with null turn, role and text.
    """
    named = df.select(*keys, F.col(record).alias("__record"), record_fingerprint(F.col(record)).alias("__print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (shape, how) in LAYOUTS.items():
        if how[0][0] == "row":
            continue  # a record is a whole conversation
        hit = F.col("__print") == hashlib.sha256(_variant_shape(shape).encode()).hexdigest()
        layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, _record_turns(F.col("__record"), how)).otherwise(turns)
    out = named.select(*keys, layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "__turn"))
    return out.select(*keys, "layout", F.col("turn").cast("long").alias("turn"), F.col("__turn.role").alias("role"), F.col("__turn.text").alias("text"))


#: Fingerprint -> layout name, and the paths that any layout knows.
TABLES = {fingerprint(shape_paths(shape)): name for name, (shape, _) in LAYOUTS.items()}
KNOWN = frozenset(p for shape, _ in LAYOUTS.values() for p in shape_paths(shape))


def table_layout(kind: T.StructType) -> str:
    """The layout that a table's schema selects, by its fingerprint."""
    paths = field_paths(kind)
    found = TABLES.get(fingerprint([p for p in paths if p in KNOWN]))
    if found is None:
        raise ValueError(f"no layout has the field paths {paths}")
    return found


def _column_turns(turns: tuple) -> Column:
    """As ``_record_turns``, of columns."""
    parts = []
    for turn in turns:
        if turn[0] == "each":
            _, path, role, text = turn
            parts.append(F.transform(F.coalesce(F.col(path), F.array()), _turn(role, text)))
        else:
            role, fields = turn
            texts = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
            parts.append(F.array(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(texts, lambda x: x != ""), "\n").alias("text"))))
    return F.concat(*parts)


def turns_from_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Canonical turns of a table: conv_id, turn, role, text; its layout is chosen by the fingerprint of its schema.

    Tables of a conversation a row take its id from ``key``.
    """
    turns = LAYOUTS[table_layout(df.schema)][1]
    if turns[0][0] == "row":
        _, conversation, turn, role, text = turns[0]
        return df.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = df.select(F.col(key).cast("long").alias("conv_id"), F.posexplode(_column_turns(turns)).alias("turn", "x"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of each control string, escaped or not."""
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: DataFrame, key: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """One formatted text per conversation, with its loss mask: ``key``, formatted, loss_spans (start, length).

    Turns go by turn, then role, then text; repeated rows are repeated turns. The mask covers the text of each turn of
    role ``trained``, without markers, in code points of ``formatted``. All turns of a conversation meet in one row.
    """
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = turns.select(F.col(key), "turn", "role", "text", head.alias("__head"), body.alias("__body"))
    w = Window.partitionBy(key).orderBy("turn", "role", "text")
    length = F.length("__head") + F.length("__body") + F.lit(len(CLOSE))
    placed = rows.select(
        key, F.row_number().over(w).alias("__n"), F.concat("__head", "__body", F.lit(CLOSE)).alias("__out"),
        (F.sum(length.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - length + F.length("__head")).alias("start"),
        F.length("__body").cast("long").alias("length"), (F.col("role") == trained).alias("__loss"),
    )
    all_turns = F.array_sort(F.collect_list(F.struct("__n", "__out", "start", "length", "__loss")))
    grouped = placed.groupBy(key).agg(all_turns.alias("__turns"))
    return grouped.select(
        key, F.array_join(F.transform("__turns", lambda t: t["__out"]), "").alias("formatted"),
        F.transform(F.filter("__turns", lambda t: t["__loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text). ``split`` finds only true markers, as texts are escaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            _unescape_role(F.substr(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2))).alias("text"),
        ),
    )


def digests(rendered: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and hashes of what can be read back from the formatted text, and of the text under the loss mask."""
    back = rendered.select(key, "formatted", "loss_spans", read_back(F.col("formatted")).alias("__back"))
    pieces = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = back.select(key, "formatted", "__back", F.array_join(pieces, "").alias("__loss"))
    return read.select(
        key, F.size("__back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
