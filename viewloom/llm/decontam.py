"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders and other words lose case and outer punctuation. Windows of templates
are hash-joined between benchmark items and documents if most of their words are literal; a document's other windows are
joined by their words, slot values included, to all windows of the items. Matches that overlap in both texts form runs,
and within a run every slot value of the item must stand for one value of the document, and the other way round: that
keeps questions with new numbers or names and drops chance matches. A document is contaminated by an item if a
consistent run has ``run`` words, or the whole of a shorter item, or if consistent runs cover ``share`` of the item's
windows, or of those of its windows that are mostly literal.

A bitmap of the benchmark's window hashes, of bounded size, spares most document windows the join; with more windows than
``filtered`` there is no bitmap and all are joined. Null and empty texts match nothing, an empty benchmark gives no rows,
and repeated rows are reported once. Items of fewer than ``literal`` words, punctuation by itself not counted, are looked for
by all their words as they stand, in whatever case; those of fewer than ``alone`` words, punctuation included, would be
found in clean texts, so only a document that has no other words holds them. An item without words is in no document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.minhash import _mix
from viewloom.llm.store import keep
from viewloom.llm.worker import held, lean, trimmed


@dataclass(frozen=True)
class Settings:
    window: int = 8
    literal: int = 5
    run: int = 13
    share: float = 0.5
    alone: int = 3
    filtered: int = 4_000_000


#: Words that stand for numbers, and units.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh watt watts volt volts joule joules".split())

#: How a window is hashed: by its template, by its words with the values of their slots, or as it stands.
TEMPLATE, LITERAL, VERBATIM = 0, 1, 2
NUM, NAME, UNIT = (xxhash.xxh3_64_intdigest(k) & ~15 for k in (b"<num>", b"<name>", b"<unit>"))
#: A word is written with a capital, ends a sentence, has punctuation after it, may go on with the slot of the word before.
_CAPITAL, _ENDS, _CLOSED, _JOINS = 1, 2, 4, 8
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{0,3})")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


class _Literal(dict):
    """Word -> hash of its lowered core, whatever it stands for."""

    def __missing__(self, raw: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(_OUTER.sub("", raw.decode("utf-8", "replace")).lower()) & ~15
        if len(self) < 100_000:
            self[raw] = out
        return out


class _Canon(dict):
    """Word -> hash of its canonical form, with flags in the lowest bits; 0 for a word of punctuation only."""

    def __init__(self) -> None:
        self.literal = _Literal()

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core = word if word.isalpha() else _OUTER.sub("", word)
        low = core.lower()
        closed = 0 if core and word.endswith(core) else _CLOSED
        opens = bool(core) and word.startswith(core)
        ends = _ENDS if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?") else 0
        if not core:
            out = ends
        elif low in NUMBERS or (not low.isalpha() and _NUMBER.fullmatch(low)):
            out = NUM | ends | closed | (_JOINS if opens and low in NUMBERS else 0)
        elif low in UNITS:
            out = UNIT | ends | closed
        else:
            capital = core[0].isupper() and core[1:].islower()
            out = (xxhash.xxh3_64_intdigest(low) & ~15) | ends | closed | (_CAPITAL | (_JOINS if opens else 0) if capital else 0)
        if len(self) < 400_000:
            self[raw] = out
        return out


def _read(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """As ``canonical``, the hashes that literal words have; those of names are their own, those of numbers and units their
    slots', and the places where the template's words begin if the words of one value, as of a name or of a number in words, are one."""
    words = (text or "").encode().split()
    found = np.fromiter(map(held("canonical", _Canon).__getitem__, words), np.uint64, len(words))
    ends = (found & np.uint64(_ENDS)) > 0
    starts = np.concatenate([[True], ends[:-1]])[: len(found)]
    name = ((found & np.uint64(_CAPITAL)) > 0) & ~starts
    own = found & ~np.uint64(15)
    at = np.flatnonzero(own)
    template = np.where(name, np.uint64(NAME), own)[at]
    flags = found[at]
    # few words have a slot's template and may go on
    later = np.flatnonzero(((flags & np.uint64(_JOINS)) > 0) & _is_slot(template))
    later = later[later > 0]
    same = (template[later] == template[later - 1]) & (at[later] == at[later - 1] + 1) & ((flags[later - 1] & np.uint64(_CLOSED)) == 0)
    begins = np.ones(len(at), bool)
    begins[later[same]] = False
    return template, at, words, own[at], np.flatnonzero(begins)


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Template word hashes, the place of each among the text's words, and the words. A capital not at a sentence's begin is a name."""
    return _read(text)[:3]


def literals(own: np.ndarray, at: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Hashes of the words with the values of their slots."""
    out, known = own.copy(), held("canonical", _Canon).literal
    slots = np.flatnonzero((own == np.uint64(NUM)) | (own == np.uint64(UNIT)))
    out[slots] = np.fromiter((known[words[i]] for i in at[slots].tolist()), np.uint64, len(slots))
    return out


def _is_slot(template: np.ndarray) -> np.ndarray:
    return (template == np.uint64(NUM)) | (template == np.uint64(NAME)) | (template == np.uint64(UNIT))


def _enough(template: np.ndarray, width: int, literal: int) -> np.ndarray:
    """Whether each window has enough literal words."""
    slots = np.concatenate([[0], np.cumsum(_is_slot(template))])
    return width - (slots[width:] - slots[:-width]) >= min(literal, width)


def window_hashes(template: np.ndarray, width: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the windows that have enough literal words."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.flatnonzero(_enough(template, width, literal))
    return _stretches(template, width, begins, TEMPLATE), begins


#: Odd, so that its powers have inverses among 64-bit numbers.
_BASE = np.random.default_rng(20).integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and their inverses, as many as a text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 14)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def _stretches(words: np.ndarray, width: int, begins: np.ndarray, how: int) -> np.ndarray:
    """Hashes of ``width`` words from each begin: differences of one sum of words times powers."""
    up, down = _POWERS.of(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return _mix((sums[begins + width] - sums[begins]) * down[begins] + np.uint64((how << 32) + width))


def _rich(template: np.ndarray, folded: np.ndarray, width: int, literal: int) -> np.ndarray:
    """Begins of the windows of words with too few literal ones; of all windows if the template is shorter than one."""
    return np.arange(len(template) - width + 1) if len(folded) < width else np.flatnonzero(~_enough(template, width, literal))


def literal_hashes(words: np.ndarray, width: int, begins: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ``begins`` by ``literals``; no template has them."""
    return _stretches(words, width, begins, LITERAL)


def verbatim_hashes(words: list[bytes], width: int, alone: int) -> np.ndarray:
    """Hashes of each ``width`` words as they stand, but for case; of fewer than ``alone`` only if there are no others."""
    n = len(words) - width + 1
    if n <= 0 or (width < alone and n > 1):
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh3_64_intdigest(w.decode("utf-8", "replace").lower()) for w in words], np.uint64)
    return _stretches(each, width, np.arange(n), VERBATIM)


_KIND = {NUM: "#", NAME: "@", UNIT: "~"}


def slot_values(template: np.ndarray, at: np.ndarray, words: list[bytes], begins: np.ndarray, begin: int, width: int) -> str:
    """place:kind:value of each slot in a window, by line. begins: where the words of the template begin."""
    out = []
    for j in range(begin, begin + width):
        lo = int(begins[j])
        kind = _KIND.get(int(template[lo]))
        if kind:
            hi = int(begins[j + 1]) if j + 1 < len(begins) else len(at)
            value = " ".join(_OUTER.sub("", words[at[k]].decode("utf-8", "replace")).lower() for k in range(lo, hi))
            out.append(f"{j}:{kind}:{value}")
    return "\n".join(out)


def _windows(rows: DataFrame, key: str, text: str, widths: dict[int, list[int]], s: Settings, whole: bool, bits: np.ndarray | None) -> DataFrame:
    """hash, id, how, place, slots of windows, and of a text's words, windows and usable (those that can match) for ``how``.

    A template's words are its literal words and whole slot values; ``first`` and ``past`` are a window's place among the text's words.

    With ``whole`` those of items (a shorter item is one window), hashed by words too, else those the bitmap lets pass,
    hashed by words only where the template has too few literal ones.
    """
    names = ["hash", "id", "how", "place", "slots", "words", "windows", "usable", "first", "past", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                template, at, words, own, starts = _read(value.as_py())
                total, plain = len(template), None
                folded, each = template[starts], np.arange(total)
                made = []
                for width in [min(s.window, len(folded))] if whole else widths[TEMPLATE]:
                    if s.literal <= width <= len(folded):
                        hashes, begins = window_hashes(folded, width, s.literal)
                        made.append((TEMPLATE, width, hashes, begins, starts, len(begins)))
                for width in [min(s.window, total)] if whole else widths[LITERAL]:
                    if s.literal <= width <= total:
                        n = total - width + 1
                        rich = each[:n] if whole else _rich(template, folded, width, s.literal)
                        if len(rich):
                            plain = literals(own, at, words) if plain is None else plain
                            made.append((LITERAL, width, literal_hashes(plain, width, rich), rich, each, n))
                for width in ([len(words)] if total < s.literal and words else []) if whole else widths[VERBATIM]:
                    hashes = verbatim_hashes(words, width, s.alone)
                    made.append((VERBATIM, width, hashes, np.arange(len(hashes)), np.arange(len(words)), 1))
                for how, width, hashes, begins, of, usable in made:
                    if bits is not None and len(hashes):
                        bit = (hashes % np.uint64(len(bits) * 8)).astype(np.int64)
                        hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        hashes, begins = hashes[hit], begins[hit]
                    for h, b in zip(hashes.view(np.int64).tolist(), begins.tolist(), strict=True):
                        if how == VERBATIM:
                            out.append((h, i, how, b, "", len(words), 1, 1, b, b + width, len(words)))
                            continue
                        past = int(of[b + width]) if b + width < len(of) else total
                        out.append((h, i, how, b, slot_values(template, at, words, of, b, width), total, len(of) - width + 1, usable, int(of[b]), past, len(of)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string() if k == 4 else pa.int64()) for k in range(11)], names)

    return lean(rows).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(trimmed(run), "hash long, id long, how long, place long, slots string, words long, windows long, usable long, first long, past long, length long")


def _pairs(doc: dict[int, tuple[str, str]], item: dict[int, tuple[str, str]], shift: int, lo: int, hi: int, seen: tuple[dict, dict]) -> bool:
    """Whether the slots of an item's words lo..hi-1 agree with those seen; adds them."""
    there, back = seen
    for p in range(lo, hi):
        if p in item:
            a, b = item[p], doc.get(p + shift, ("", ""))
            if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return False
    return True


def consistent_runs(places: list[int], width: int, doc: dict, item: dict, shift: int) -> list[tuple[int, int]]:
    """(first word, words) of the longest runs of windows whose slots are consistent, each overlapping the last one.

    Windows in between, of too few literal words to be hashed, are covered by their neighbours.
    """
    out: list[tuple[int, int]] = []
    begin, last, seen = None, None, ({}, {})
    for p in [*sorted(set(places)), None]:
        follows = p is not None and last is not None and p < last + width
        if not (follows and _pairs(doc, item, shift, p, p + width, seen)):
            if begin is not None:
                out.append((begin, last - begin + width))
            begin, seen = p, ({}, {})
            if p is not None and not _pairs(doc, item, shift, p, p + width, seen):
                begin = last = None
                continue
        last = p
    return out


def _slots(text: list[str]) -> dict[int, tuple[str, str]]:
    return {int(place): (kind, value) for line in text if line for place, kind, value in (x.split(":", 2) for x in line.split("\n"))}


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings | None = None, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, run_words (the longest consistent run), matched and windows (of the item's), verbatim (no slot differs in that run)."""
    s = settings or Settings()
    wanted = keep(_windows(items, item_key, text, {}, s, True, None), "items")
    n = wanted.count()
    width = F.when(F.col("how") == VERBATIM, F.col("length")).otherwise(F.least(F.lit(s.window), "length"))
    lengths = wanted.select("how", width.alias("width")).distinct().collect()
    widths = {how: sorted(r["width"] for r in lengths if r["how"] == how) for how in (TEMPLATE, LITERAL, VERBATIM)}
    bits = None
    if n <= s.filtered:
        size = 1 << max(20, min(28, (64 * n).bit_length()))
        bit = np.array([r["hash"] for r in wanted.select("hash").distinct().collect()], np.int64).view(np.uint64) % np.uint64(size)
        flags = np.zeros(size, bool)
        flags[bit.astype(np.int64)] = True
        bits = np.packbits(flags, bitorder="little")
    found = _windows(docs.filter(F.col(key).isNotNull()), key, text, widths, s, False, bits)
    about = ["item_id", "how", "words", "windows", "usable", "length"]
    mine = wanted.select("hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "first", "past", *[F.col("id").alias(c) if c == "item_id" else F.col(c) for c in about])
    # a short item's windows have another width, and so other hashes
    met = found.select("hash", F.col("id").alias("doc_id"), "place", "slots").join(mine, "hash").distinct()
    match = F.struct("item_place", "slots", "item_slots", "first", "past")
    runs = met.groupBy("doc_id", *about, (F.col("place") - F.col("item_place")).alias("shift")).agg(F.collect_list(match).alias("met"))
    names = ["doc_id", *about, "run_words", "verbatim", "places", "hit"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *of, shift, got in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                width = of[6] if of[2] == VERBATIM else min(s.window, of[6])
                doc, item = _slots([m["slots"] for m in got]), _slots([m["item_slots"] for m in got])
                places = {m["item_place"]: m for m in got}
                for begin, size in consistent_runs(list(places), width, doc, item, shift):
                    same = all(doc.get(p + shift) == item[p] for p in range(begin, begin + size) if p in item)
                    covered = range(begin, begin + size - width + 1)
                    size = places[covered[-1]]["past"] - places[begin]["first"]
                    out.append((*of, size, same, list(covered), [p for p in covered if p in places]))
            kinds = (*[pa.int64()] * 8, pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    checked = runs.mapInArrow(check, "doc_id long, item_id long, how long, words long, windows long, usable long, length long, run_words long, verbatim boolean, places array<long>, hit array<long>")
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    each = checked.groupBy("doc_id", *about).agg(F.max(F.struct("run_words", "verbatim")).alias("longest"), number("places").alias("matched"), number("hit").alias("hit"))
    enough = (F.col("longest.run_words") >= F.least(F.lit(s.run), "words")) | (F.col("matched") >= s.share * F.col("windows")) | (F.col("hit") >= s.share * F.col("usable"))
    best = each.filter(enough).groupBy("doc_id", "item_id").agg(F.max(F.struct("longest", "matched", "windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.longest.run_words", "best.matched", "best.windows", "best.longest.verbatim")
