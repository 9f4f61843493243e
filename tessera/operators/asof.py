"""Joins to the latest earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of rows with equal keys the last one in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str) -> DataFrame:
    """Each left row with the columns of the right row of the same ``by`` whose ``right_on`` is the
    latest that is not after ``left_on``; NULLs if there is none.

    Both sides go through one exchange on ``by`` and one sort: their union, right rows first at
    equal times, carries the last right row along as a whole, so that its own NULLs stay. Right
    rows must be unique on ``by`` and ``right_on`` (see ``keep_last``).
    """
    payload = [c for c in right.columns if c not in by]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keep = [c for c in left.columns if c not in by]
    struct = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(payload)])
    lefts = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c).alias(f"l{i}") for i, c in enumerate(keep)]).alias("__l"))
    rights = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), struct.alias("__r"))
    # Dealt by the first key; what is so dealt already (an earlier as-of join) stays in place.
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    # A missing key or left time matches nothing.
    known = F.col("__t").isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    values = [F.when(known, F.col(f"__m.r{i}")).alias(c) for i, c in enumerate(payload)]
    return met.select(*by, *[F.col(f"__l.l{i}").alias(c) for i, c in enumerate(keep)], *values)


def null_where(df: DataFrame, mask: Column, columns: list[str]) -> DataFrame:
    """Columns become missing where the mask holds."""
    bad = F.coalesce(mask, F.lit(False))
    return df.select(*[F.when(~bad, F.col(c)).alias(c) if c in set(columns) else F.col(c) for c in df.columns])
