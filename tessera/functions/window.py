"""Column functions along an entity's time: lags, trailing sums, averages of two ends.

Rows of one entity and time have no order of their own: ``ties`` names the columns that give it, as
a row's place in its source (``sources.io.with_row_id``). Without it such rows come in any order.

All functions of one (by, order) share one window, so Spark plans one exchange and one sort for
as many of them as one ``select`` takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .expr import INFINITY, _column


def panel(by: str, order: str, *ties: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(F.col(order).asc_nulls_last(), *ties)


def _known(by: str, value: Column) -> Column:
    """Rows without an entity are nobody's history."""
    return F.when(F.col(by).isNotNull(), value)


def group_shift(col: Column | str, periods: int, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    """The entity's value ``periods`` rows earlier (later, if negative); missing values are not skipped."""
    return _known(by, F.lag(_column(col), periods).over(panel(by, order, *ties)))


def lag_nq(col, n: int, by: str = "security_id", order: str = "rebalance_date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, n, by, order, ties)


def lag_1q(col, by: str = "security_id", order: str = "rebalance_date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 1, by, order, ties)


def lag_4q(col, by: str = "security_id", order: str = "rebalance_date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 4, by, order, ties)


def lag_nm(col, n: int, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, n, by, order, ties)


def lag_1m(col, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 1, by, order, ties)


def lag_3m(col, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 3, by, order, ties)


def lag_21d(col, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 21, by, order, ties)


def lag_63d(col, by: str = "security_id", order: str = "date", ties: Sequence[str] = ()) -> Column:
    return group_shift(col, 63, by, order, ties)


def rolling_sum_4q(col, by: str = "security_id", order: str = "rebalance_date", min_valid: int = 3, ties: Sequence[str] = ()) -> Column:
    """Trailing sum of four rows: four times the mean of the valid ones, of which there must be
    ``min_valid``; NULL before an entity's fourth row. Infinite values count as missing."""
    x = _column(col)
    x = F.when(~F.isnan(x) & (F.abs(x) < INFINITY), x)
    w = panel(by, order, *ties)
    last4 = w.rowsBetween(-3, 0)
    full = (F.row_number().over(w) >= 4) & (F.count(x).over(last4) >= min_valid)
    return _known(by, F.when(full, F.avg(x).over(last4) * 4))


ttm = rolling_sum_4q


def _two_ends(col: str, by: str, order: str, ties: Sequence[str]) -> Column:
    return (F.col(col) + lag_4q(col, by, order, ties)) * F.lit(0.5)


def avg_total_assets(by: str = "security_id", order: str = "rebalance_date", col: str = "total_assets", ties: Sequence[str] = ()) -> Column:
    """Mean of now and four quarters ago; missing if either is."""
    return _two_ends(col, by, order, ties)


def avg_book_equity(by: str = "security_id", order: str = "rebalance_date", col: str = "book_equity", ties: Sequence[str] = ()) -> Column:
    return _two_ends(col, by, order, ties)


def avg_inventory(by: str = "security_id", order: str = "rebalance_date", col: str = "inventory", ties: Sequence[str] = ()) -> Column:
    return _two_ends(col, by, order, ties)
