"""Winsorised cross-sectional scores and rolling ranks in an entity's own history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import finite, number
from .window import _known, panel


def winsorize(df: DataFrame, col: str, by: str, out: str | None = None, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clips at the group's linearly interpolated quantiles; missing values stay missing."""
    x, w = number(col), Window.partitionBy(by)
    bounds = F.percentile(x, [lower, upper]).over(w)
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.get(bounds, F.lit(0))), F.get(bounds, F.lit(1))))
    return df.withColumn(out or col, clipped)


def _score(df: DataFrame, x: Column, by: str, out: str) -> DataFrame:
    y, raw = f"__{out}_y", f"__{out}_x"
    df = winsorize(df.withColumn(raw, x), raw, by, y)
    w = Window.partitionBy(by)
    # Mean rank of equal values: halfway from the rank among the smaller to that among the larger.
    up = F.rank().over(w.orderBy(F.col(y).asc_nulls_last()))
    down = F.rank().over(w.orderBy(F.col(y).desc_nulls_last()))
    n = F.count(y).over(w)
    mean_rank = (up + n + 1 - down) / F.lit(2.0)
    return df.withColumn(out, _known(by, F.when(F.col(y).isNotNull(), mean_rank / n - 0.5))).drop(y, raw)


def score(df: DataFrame, col: str, by: str = "rebalance_date", out: str = "score") -> DataFrame:
    """Share of the group at or below (ties at their mean), less one half, after winsorising."""
    return _score(df, number(col), by, out)


def score_low(df: DataFrame, col: str, by: str = "rebalance_date", out: str = "score_low") -> DataFrame:
    """``score`` where low values are good."""
    return _score(df, -number(col), by, out)


def rolling_ts_rank(col: Column | str, window: int, min_valid: int, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    """Rank of a finite value among the finite ones of the ``window`` rows before it, from -0.5 to
    0.5, equal ones counting half; needs ``min_valid`` of them and two that differ.

    The history is gathered once a row: it and the value are bound as one struct, of which the rank
    is a function."""
    x = number(col)
    history = F.collect_list(F.when(finite(x), x)).over(panel(by, order, *ties).rowsBetween(-window, -1))

    def rank(s: Column) -> Column:
        h, v = s["h"], s["x"]
        below, equal = F.size(F.filter(h, lambda y: y < v)), F.size(F.filter(h, lambda y: y == v))
        enough = finite(v) & (F.size(h) >= max(min_valid, 1)) & (F.array_min(h) < F.array_max(h))
        return F.when(enough, (below + equal * F.lit(0.5)) / F.size(h) - 0.5)

    bound = F.array(F.struct(history.alias("h"), x.alias("x")))
    return _known(by, F.get(F.transform(bound, rank), F.lit(0)))


def ts_rank_quarterly(col, window: int = 20, min_valid: int = 12, by: str = "security_id", order: str = "rebalance_date", ties: Sequence[str] = ()) -> Column:
    return rolling_ts_rank(col, window, min_valid, by, order, ties)


def ts_rank_monthly(col, window: int = 60, min_valid: int = 36, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return rolling_ts_rank(col, window, min_valid, by, order, ties)
