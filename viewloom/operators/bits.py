"""Sets of views as words of 63 bits in columns w0, w1, ...: bit i of word k is view 63k + i.

A row with such words stands for itself in all its views, so what views share is kept, shuffled and computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.timestamps import Timestamps

BITS = 63
#: Parts that a key's rows are first looked through in, so that a hub's many rows are not one task's work.
SALTS = 16


def word_names(n: int) -> list[str]:
    return [f"w{k}" for k in range(-(-n // BITS))]


def zero() -> Column:
    return F.lit(0).cast("bigint")


def full(n: int) -> list[Column]:
    """Words with the bits of all of n views."""
    return [F.lit((1 << min(BITS, n - BITS * k)) - 1).cast("bigint").alias(w) for k, w in enumerate(word_names(n))]


def bit(words: Sequence[str], i: Column) -> Column:
    """Whether view i's bit is set, as 0 or 1; i is a Column."""
    return F.getbit(F.element_at(F.array(*words), F.floor(i / BITS).cast("int") + 1), (i % BITS).cast("int")).cast("int")


def any_set(words: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(w) if isinstance(w, str) else w) != 0 for w in words])


def united(words: Sequence[str], prefix: str = "") -> list[Column]:
    """Aggregates: the views of any of a group's rows."""
    return [F.bit_or(f"{prefix}{w}").alias(f"{prefix}{w}") for w in words]


def both(words: Sequence[str], other: str) -> list[Column]:
    """The views of both sides of a join, whose words are w.. and, with the prefix, other.."""
    return [F.col(w).bitwiseAND(F.col(f"{other}{w}")).alias(w) for w in words]


def prefixed(words: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(w).alias(f"{prefix}{w}") for w in words]


def stretch(words: Sequence[str], first: int, n: int = BITS) -> Column:
    """Bits ``first`` to first + n - 1 (n up to 63) as one word; there are none before 0."""
    out = zero()
    for j, w in enumerate(words):
        off = first - BITS * j
        if 0 <= off < BITS:
            out = out.bitwiseOR(F.shiftrightunsigned(w, off))
        elif -n < off < 0:
            out = out.bitwiseOR(F.shiftleft(w, -off))
    return out.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def chosen(words: Sequence[str], views: Sequence[int]) -> list[Column]:
    """Words of only some views, in their order."""
    views = list(views)
    n = len(views)
    if views == list(range(views[0], views[0] + n)):
        return [stretch(words, views[0] + BITS * k, min(BITS, n - BITS * k)).alias(w) for k, w in enumerate(word_names(n))]
    out = []
    for k, w in enumerate(word_names(n)):
        held = [F.call_function("shiftleft", F.getbit(words[v // BITS], F.lit(v % BITS)).cast("bigint"), F.lit(i)) for i, v in enumerate(views[BITS * k : BITS * (k + 1)])]
        out.append(reduce(lambda a, b: a.bitwiseOR(b), held).alias(w))
    return out


def placed(words: Sequence[str], first: int, total: int) -> list[Column]:
    """Words of ``total`` views in which the given words' views begin at ``first``."""
    return [stretch(words, BITS * k - first, min(BITS, total - BITS * k)).alias(w) for k, w in enumerate(word_names(total))]


def words_of(conditions: Sequence[Column]) -> list[Column]:
    """Words with bit i where condition i holds."""
    out = []
    for at in range(0, len(conditions), BITS):
        word = zero()
        for i, c in enumerate(conditions[at : at + BITS]):
            word = word.bitwiseOR(F.when(c, F.lit(1 << i).cast("bigint")).otherwise(zero()))
        out.append(word.alias(f"w{at // BITS}"))
    return out


def single(at: Column, n: int) -> list[Column]:
    """Words with the one bit ``at`` (a Column) of n views."""
    return [F.when(F.floor(at / BITS) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % BITS).cast("int"))).otherwise(zero()).alias(w) for k, w in enumerate(word_names(n))]


def below(n: Column) -> Column:
    """The lowest n (0 to 63) bits."""
    return F.when(n <= 0, zero()).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (64 - n).cast("int")))


def between(first: Column, past: Column, k: int) -> Column:
    """Word k of the views first to past - 1."""
    cut = lambda x: F.least(F.greatest(x - BITS * k, F.lit(0)), F.lit(BITS))
    return below(cut(past)).bitwiseAND(F.bitwise_not(below(cut(first))))


def expand(df: DataFrame, words: Sequence[str], views: Sequence[int]) -> DataFrame:
    """One row per set bit, with the view as ts instead of the words."""
    views = list(views)
    has = F.filter(F.sequence(F.lit(0), F.lit(len(views) - 1)), lambda i: bit(words, i) == 1)
    if views == list(range(views[0], views[0] + len(views))):
        return df.withColumn("ts", F.explode(F.transform(has, lambda i: i + views[0]))).drop(*words)
    names = F.array(*[F.lit(t) for t in views])
    return df.withColumn("ts", F.explode(F.transform(has, lambda i: F.get(names, i)))).drop(*words)


def least_first(df: DataFrame, key: str, value: str, words: Sequence[str], wide: bool = False, mark: str | None = None) -> DataFrame:
    """Each view only in its key's row of the least value (then ``mark``); rows without views go.

    wide: a key may have very many rows. They are looked through in parts first, which leave few: a row stays only for views
    that no smaller value of its part has.
    """

    def left(rows: DataFrame, *by) -> DataFrame:
        w = Window.partitionBy(key, *by).orderBy(value, *([mark] if mark else [])).rowsBetween(Window.unboundedPreceding, -1)
        named = rows.select(*rows.columns, *[F.coalesce(F.bit_or(x).over(w), zero()).alias(f"__{x}") for x in words])
        rest = [F.col(x).bitwiseAND(F.bitwise_not(f"__{x}")).alias(x) for x in words]
        return named.select(*[c for c in rows.columns if c not in words], *rest).filter(any_set(words))

    return left(left(df, F.pmod(F.xxhash64(value), F.lit(SALTS))) if wide else df)


def changes(words: Sequence[str], stamps: Timestamps, splits: Sequence[int] = ()) -> Column:
    """array of (ts, diff) where a row comes or goes between views; a view of ``splits`` starts from nothing."""
    n = len(stamps)
    views = F.sequence(F.lit(0), F.lit(n - 1))
    if len(stamps.lengths) == 1:
        fresh = F.array(*[F.lit(s) for s in {0, *splits}])
        own = lambda i: bit(words, i) - F.when(F.array_contains(fresh, i), 0).otherwise(bit(words, F.greatest(i - 1, F.lit(0))))
    else:
        signed = lambda pairs: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in pairs]) if pairs else F.array().cast("array<struct<i:int,s:int>>")
        near = F.array(*[signed([] if i in set(splits) else stamps.before(i)) for i in range(n)])
        own = lambda i: bit(words, i) - F.aggregate(F.get(near, i), F.lit(0), lambda s, x: s + x["s"] * bit(words, x["i"]))
    return F.filter(F.transform(views, lambda i: F.struct(i.alias("ts"), own(i).alias("diff"))), lambda x: x["diff"] != 0)


@dataclass
class Masked:
    """A result of all ``views`` at once: rows of own columns, diff (the multiplicity) and the words of the views that have them.

    A view's multiplicity of a row is the sum over the rows of its bit.
    """

    rows: DataFrame
    views: Sequence[int]
    #: Whether equal rows may have common views.
    adds: bool = False

    @property
    def words(self) -> list[str]:
        return word_names(len(self.views))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("diff", *self.words)]

    @staticmethod
    def of(df: DataFrame, views: Sequence[int]) -> Masked:
        """From ts, columns, diff."""
        views = list(views)
        at = F.col("ts") - views[0] if views == list(range(views[0], views[0] + len(views))) else F.array_position(F.array(*[F.lit(v) for v in views]), F.col("ts")).cast("int") - 1
        keys = [c for c in df.columns if c != "ts"]
        marked = df.select(*keys, *single(at, len(views)))
        return Masked(marked.groupBy(*keys).agg(*united(word_names(len(views)))), views)

    def full(self) -> DataFrame:
        """ts, columns, diff of each view."""
        out = expand(self.rows, self.words, self.views).select("ts", *self.columns, "diff")
        return out.groupBy("ts", *self.columns).agg(F.sum("diff").alias("diff")) if self.adds else out

    def among(self, total: int) -> Masked:
        """The same, of views that begin at views[0] among ``total``."""
        keys = [*self.columns, "diff"]
        return Masked(self.rows.select(*keys, *placed(self.words, self.views[0], total)), range(total), self.adds)

    def differences(self, stamps: Timestamps, splits: Sequence[int] = ()) -> DataFrame:
        """ts, columns, diff: what changes from view to view, read from the bits."""
        c = F.explode(changes(self.words, stamps, splits)).alias("c")
        rows = self.rows.select(*self.columns, "diff", c).select(F.col("c.ts").alias("ts"), *self.columns, (F.col("diff") * F.col("c.diff")).alias("diff"))
        return rows.groupBy("ts", *self.columns).agg(F.sum("diff").alias("diff")).filter("diff <> 0")
