"""Column functions: missing values, ratios, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are both missing: every float column gets NULL for NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def number(c: Column | str) -> Column:
    """As DOUBLE; what is no number, and NaN, becomes NULL."""
    x = _column(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column | str) -> Column:
    """True for a number that is neither missing nor infinite; never NULL."""
    x = _column(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INFINITY), F.lit(False))


def holds(mask: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(mask, F.lit(False))


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL where a side is missing or den is 0."""
    return F.try_divide(number(num), number(den))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """|a - b| <= atol + rtol * |b|; b is the side of reference."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def market_cap_mn(close: str = "equity_close_raw", shares_k: str = "equity_shares_outstanding_k") -> Column:
    """Market capitalisation in millions: price times shares in thousands."""
    return F.col(close) * F.col(shares_k) / F.lit(1000.0)


def scaled_return(r: Column | str, unit: str) -> Column:
    """Returns as fractions; ``unit`` says what the column holds."""
    if unit not in ("fraction", "percent"):
        raise ValueError(f"return unit must be fraction or percent, not {unit!r}")
    return number(r) / F.lit(100.0) if unit == "percent" else number(r)


def month_index(d: Column | str) -> Column:
    """Months since year 0; h months later is this plus h."""
    return F.year(d) * 12 + F.month(d)


def previous_quarter_end(d: Column | str) -> Column:
    """The quarter end before quarter end ``d``."""
    return F.last_day(F.add_months(d, -3))


def flag_true(df: DataFrame, name: str) -> Column:
    """True where a flag column says so: true, or the number 1; a string never."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return holds(F.col(name))
    if isinstance(kind, T.NumericType):
        return holds(F.col(name) == 1)
    return F.lit(False)


#: Units of a day.
PER_DAY = {"s": 86_400, "ms": 86_400_000, "us": 86_400_000_000, "ns": 86_400_000_000_000}


def _day_number(name: str, unit: str) -> Column:
    """The UTC day of a whole number of ``unit`` since the epoch, by integer division downwards."""
    n, per = f"cast(`{name.replace('`', '``')}` as bigint)", f"{PER_DAY[unit]}L"
    return F.expr(f"date_from_unix_date(cast(({n} - pmod({n}, {per})) div {per} as int))")


def as_date(df: DataFrame, name: str, strict: bool = True, unit: str | None = None) -> Column:
    """A column of any kind of date as DATE (UTC): dates, timestamps with or without zone, ISO
    strings, and whole numbers since the epoch in ``unit`` (``PER_DAY``). Strings that are no date
    raise, or with ``strict=False`` give NULL.

    Without a unit, numbers below 10^15 (the year 33658) are milliseconds and others nanoseconds, as
    which timestamps of that precision load; microseconds, and nanoseconds within eleven days of
    1970, cannot be told apart and need their unit."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return c
    if isinstance(kind, (T.LongType, T.IntegerType)):
        if unit:
            return _day_number(name, unit)
        return F.when(F.abs(c) >= F.lit(10**15), _day_number(name, "ns")).otherwise(_day_number(name, "ms"))
    if isinstance(kind, T.StringType):
        return (F.to_timestamp(c) if strict else F.try_to_timestamp(c)).cast("date")
    return c.cast("date")
