"""Results of computations per view: from full results to differences and back, and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators.timestamps import Timestamps

#: A result has ts, columns of its own, and diff, the multiplicity.


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ts", "diff")]


def consolidate(df: DataFrame) -> DataFrame:
    """Sum the multiplicities of equal rows and drop those of none."""
    return df.groupBy("ts", *_columns(df)).agg(F.sum("diff").alias("diff")).filter("diff <> 0")


def _spread(df: DataFrame, targets: list[list[tuple[int, int]]]) -> DataFrame:
    table = F.array(*[F.array(*[F.struct(F.lit(j).alias("ts"), F.lit(s).cast("long").alias("s")) for j, s in row]) if row else F.array().cast("array<struct<ts:int,s:bigint>>") for row in targets])
    out = df.select(F.explode(F.get(table, F.col("ts"))).alias("to"), *_columns(df), "diff")
    return consolidate(out.select(F.col("to.ts").alias("ts"), *_columns(df), (F.col("diff") * F.col("to.s")).alias("diff")))


def differences(full: DataFrame, stamps: Timestamps, splits: Sequence[int] = ()) -> DataFrame:
    """Each view's difference to the views before; at a split it is the whole result."""
    targets = [[(j, s) for j, s in stamps.after(i) if j == i or j not in set(splits)] for i in range(len(stamps))]
    return _spread(full, targets)


def accumulate(diffs: DataFrame, stamps: Timestamps, splits: Sequence[int] = ()) -> DataFrame:
    """Each view's whole result from differences; at a split sums begin anew."""
    targets = []
    for i in range(len(stamps)):
        later = [s for s in splits if s > i]
        targets.append([(j, 1) for j in stamps.since(i) if not later or j < min(later)])
    return _spread(diffs, targets)


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicities differ: ts, columns, diff (of a less that of b)."""
    return consolidate(a.unionByName(b.withColumn("diff", -F.col("diff"))))
