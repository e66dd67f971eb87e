"""Secret scans: base patterns, and sliding-window Shannon entropy per character class over candidate strings.

Main path: DataFrame functions only. No pattern can match across a line end, spans are in code points with exclusive
ends, and null texts count as empty. Every match in the whole text is found, however long it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Spans of equal start go in this order.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars`` of ``least`` or more; a window of ``width`` with ``bits`` of entropy or more is hot."""

    kind: str
    chars: str
    alphabet: str
    least: int
    width: int
    bits: float


HEX_CHARS = "0123456789abcdef"
BASE64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", HEX_CHARS, 24, 20, 2.9), CharClass("entropy_base64", "A-Za-z0-9+/_=-", BASE64_CHARS, 24, 24, 4.0))
#: A candidate that one of these matches in full is suppressed: without both letters and digits, a UUID, counting rows, documented examples.
ALLOWED = (r"[^0-9]*", r"[^A-Za-z]*", r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r".*(0123456789|abcdefghij|ABCDEFGHIJ).*", r".*EXAMPLE.*")
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
_BLOCK = 256


def _none() -> Column:
    return F.array().cast(SPANS)


def _starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of lengths, in blocks, so that appending to arrays stays cheap for long arrays."""

    def sums(values: Column) -> Column:
        seed = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, seed, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, sums(totals), lambda b, at: F.transform(sums(b), lambda x: x + at)))


def _found(text: Column, pattern: str, kind: str, wanted=None) -> Column:
    """The spans of all matches: what split() leaves between them, and their own lengths, add up to their places."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = F.lit(KINDS.index(kind))
    gaps = F.transform(F.slice(between, F.lit(1), F.size(matches)), lambda x: F.length(x).cast("bigint"))
    sizes = F.transform(matches, lambda x: F.length(x).cast("bigint"))
    pairs = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
    steps = F.transform(pairs, lambda p: p["gap"] + p["size"])
    spans = F.zip_with(_starts(steps), pairs, lambda at, p: F.struct((at + p["gap"]).alias("start"), rank.alias("rank"), (at + p["gap"] + p["size"]).alias("end"), F.lit(kind).alias("kind")))
    if wanted is not None:
        spans = F.filter(F.zip_with(spans, wanted(text, matches), lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), spans.cast(SPANS)).otherwise(_none())


def _long_value(text: Column, matches: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)


def base_spans(text: Column) -> Column:
    """All spans of the three base kinds, unsorted."""
    return F.concat(_found(text, ASSIGN, "assign", _long_value), _found(text, ACCESS, "access"), _found(text, HEX, "hex"))


def hot_range(candidate: Column, c: CharClass) -> Column:
    """(first, last) start of the candidate's hot windows, null if none is hot.

    One pass with the counts of the window's characters: each step adds the entering and drops the leaving character and
    updates S, the sum of n * log2(n) over the counts; the entropy is log2(width) - S / width.
    """
    chars = F.transform(F.split(F.lower(candidate) if c.alphabet == HEX_CHARS else candidate, ""), lambda x: F.instr(F.lit(c.alphabet), x) - 1)
    f = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    seed = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), chars.alias("chars"),
    )

    def enter(s: Column, x: Column) -> Column:
        gone = F.when(s["i"] >= c.width, F.get(s["chars"], s["i"] - c.width)).otherwise(F.lit(-1))
        came, left = F.get(s["n"], x), F.when(gone >= 0, F.get(s["n"], gone) + F.when(gone == x, 1).otherwise(0)).otherwise(F.lit(0))
        total = s["s"] + f(came + 1) - f(came) + F.when(gone >= 0, f(left - 1) - f(left)).otherwise(F.lit(0.0))
        counts = F.transform(s["n"], lambda n, k: n + F.when(k == x, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
        at = s["i"] - (c.width - 1)
        hot = (at >= 0) & (F.lit(math.log2(c.width)) - total / c.width >= c.bits - 1e-9)
        return F.struct(counts.alias("n"), total.alias("s"), (s["i"] + 1).alias("i"), F.when(hot & s["first"].isNull(), at).otherwise(s["first"]).alias("first"), F.when(hot, at).otherwise(s["last"]).alias("last"), s["chars"].alias("chars"))

    return F.aggregate(chars, seed, enter, lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def entropy_spans(text: Column, c: CharClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """For each candidate that no allow-list entry matches, the span from its first to its last hot window."""
    pattern = f"[{c.chars}]{{{c.least},}}"
    benign = f"^(?:{'|'.join(allowed)})$"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ranges = F.transform(matches, lambda m: F.when(~m.rlike(benign), hot_range(m, c)))
    moved = lambda s, r: F.when(r.isNotNull(), F.struct((s["start"] + r["first"]).alias("start"), s["rank"].alias("rank"), (s["start"] + r["last"] + c.width).alias("end"), s["kind"].alias("kind")))
    hot = F.filter(F.zip_with(_found(text, pattern, c.kind), ranges, moved), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), hot.cast(SPANS)).otherwise(_none())


def masked(text: Column, spans: Column) -> Column:
    """The text with line ends in the place of the spans, which may overlap; all other characters keep their places."""
    seed = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(text, (s["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - s["at"]).cast("int"))
        return F.struct(F.concat(s["out"], gap, F.repeat(F.lit("\n"), F.greatest(F.lit(0), x["end"] - F.greatest(s["at"], x["start"])).cast("int"))).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    whole = F.aggregate(F.array_sort(spans), seed, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def scan_all(docs: DataFrame, text: str = "text", *others: str) -> DataFrame:
    """As ``scan``, but no span goes because it touches another: for secrets that are joined to a base hit.

    What lies between base spans is searched once more by itself, so that a base hit on the allow-list hides no more than itself.
    """
    out = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = out.withColumn("__base", base_spans(F.col("__text")))
    out = out.withColumn("__rest", F.when(F.size("__base") > 0, masked(F.col("__text"), F.col("__base"))).otherwise(F.lit("")))
    found = [entropy_spans(F.col(c), k) for c in ("__text", "__rest") for k in CLASSES]
    return out.select(*others, F.col("__text").alias("__scanned"), F.array_sort(F.concat("__base", *found)).alias("spans"))


def scan(docs: DataFrame, text: str = "text", *others: str) -> DataFrame:
    """``others`` and ``spans`` (start, rank, end, kind; by start, then kind) of each row.

    Base spans always stay; entropy spans that touch a base span, and base64 spans that touch a hex one, add nothing and
    go. Texts without findings have an empty array. Repeated rows give repeated results.
    """
    hexes, base64 = CLASSES
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = lambda new, old: F.filter(new, lambda a: ~F.exists(old, lambda b: touches(a, b)))
    out = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = out.withColumns({"__base": base_spans(F.col("__text")), "__hex": entropy_spans(F.col("__text"), hexes), "__b64": entropy_spans(F.col("__text"), base64)})
    out = out.withColumn("__hex", apart(F.col("__hex"), F.col("__base")))
    out = out.withColumn("__spans", F.array_sort(F.concat("__base", "__hex", apart(F.col("__b64"), F.concat("__base", "__hex")))))
    return out.select(*others, F.col("__text").alias("__scanned"), F.col("__spans").alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, hash and spans per document (doc_id, text)."""
    found = scan(docs, "text", "doc_id").select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with each maximal run of overlapping spans replaced by ``mark``; null texts stay null."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name meets those used here
    found = scan_all(docs.toDF(*own.values()), own[text], *own.values())
    # spans that touch are one; then the text between them is cut out of blocks of it, so that no cut goes through all of it
    seed = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        joins = (F.size(s) > 0) & (x["start"] < F.when(F.size(s) > 0, last["end"]))
        here = F.struct(F.when(joins, last["start"]).otherwise(x["start"]).alias("start"), F.when(joins, F.greatest(last["end"], x["end"])).otherwise(x["end"]).alias("end"))
        return F.concat(F.when(joins, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s), F.array(here))

    merged = found.withColumn("merged", F.aggregate("spans", seed, step))
    blocks = F.regexp_extract_all("__scanned", F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    pieces = F.transform(blocks, lambda text, b: _between(text, b, F.col("merged"), mark))
    out = merged.withColumn("clean", F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col(own[text])))
    return out.select(*[F.col("clean" if c == text else own[c]).alias(c) for c in docs.columns])


#: Code points of a block of text that spans are cut from.
_CUT = 8192


def _between(text: Column, b: Column, spans: Column, mark: str) -> Column:
    """Block b of a text without the spans in it, with a mark where one begins."""
    first = (b * _CUT).cast("bigint")
    here = F.filter(spans, lambda s: (s["start"] < first + _CUT) & (s["end"] > first))
    seed = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, x: Column) -> Column:
        begin, end = F.greatest(x["start"] - first, F.lit(0).cast("bigint")), F.least(x["end"] - first, F.lit(_CUT).cast("bigint"))
        gap = F.substr(text, (s["at"] + 1).cast("int"), (begin - s["at"]).cast("int"))
        return F.struct(F.concat(s["out"], F.array(F.concat(gap, F.when(x["start"] >= first, F.lit(mark)).otherwise(F.lit(""))))).alias("out"), end.alias("at"))

    return F.aggregate(here, seed, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["at"] + 1).cast("int"))))
