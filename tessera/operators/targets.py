"""Forward total returns from month end to month end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_date, finite, holds, month_index, scaled_return
from ..sources.schema import unique
from .quality import with_calendar


def return_state(daily: DataFrame, return_unit: str = "fraction", identifiers: list[str] | None = None) -> DataFrame:
    """Running sum of log returns and running count of days that break the chain.

    A day counts if the security was observed on the market's previous date and its return is a
    number above -1. Any interval's product is then a difference of two sums, and the interval
    is whole if the two counts agree."""
    ids = unique(identifiers or ["security_id", "ticker"])
    d = daily.select(*ids, as_date(daily, "date").alias("date"), scaled_return("equity_total_return", return_unit).alias("__r"))
    d = with_calendar(d)
    w = Window.partitionBy("security_id").orderBy("date")
    valid = F.col("security_id").isNotNull() & holds(F.lag("date").over(w) == F.col("prev_market")) & holds(finite("__r") & (F.col("__r") > -1))
    d = d.withColumn("__valid", valid)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = F.sum(F.when(F.col("__valid"), F.log1p("__r")).otherwise(F.lit(0.0))).over(so_far)
    broken = F.sum(F.when(F.col("__valid"), F.lit(0)).otherwise(F.lit(1)).cast("long")).over(so_far)
    # The market's last date of a month: nothing was observed on a later one of the same month.
    last = F.col("next_market").isNull() | (F.last_day("next_market") != F.last_day("date"))
    return d.select(*ids, "date", log.alias("cum_log_return"), broken.alias("cum_invalid"), last.alias("market_month_end"))


def market_month_end(state: DataFrame) -> DataFrame:
    """Rows on the last date of the month on which anything traded; the month's number beside."""
    return state.where("market_month_end").drop("market_month_end").withColumn("month", month_index("date"))


def horizon_targets(month_ends: DataFrame, months: int, quarter_end_only: bool = False) -> DataFrame:
    """Total return over the next ``months`` months from each month end; missing if the security
    has no row at that end or a day between breaks the chain. Rows without a target stay.

    The row ``months`` later is the one row in a range frame of exactly that distance, so the
    panel is neither scanned nor shuffled again for a join with itself. Two rows of a security in one
    month end raise when the plan runs: their returns would be a matter of chance."""
    target, end = f"target_{months}m", f"target_{months}m_end_date"
    ids = [c for c in month_ends.columns if c not in ("date", "month", "cum_log_return", "cum_invalid")]
    w = Window.partitionBy("security_id").orderBy("month").rangeBetween(months, months)
    own = Window.partitionBy("security_id").orderBy("month").rangeBetween(0, 0)
    met = month_ends.withColumn("__end", F.first(F.struct("date", "cum_log_return", "cum_invalid")).over(w)).withColumn("__n", F.count("*").over(own))
    met = met.withColumn("security_id", F.when((F.col("__n") > 1) & F.col("security_id").isNotNull(), F.raise_error(F.concat(F.lit("several rows at a month end of security "), F.col("security_id").cast("string")))).otherwise(F.col("security_id")))
    if quarter_end_only:  # of the samples only; any month end may be an endpoint
        met = met.where(F.month("date").isin(3, 6, 9, 12))
    whole = F.col("__end.cum_invalid") == F.col("cum_invalid")
    value = F.when(whole, F.expm1(F.col("__end.cum_log_return") - F.col("cum_log_return")))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return met.select(*ids, iso("date").alias("date"), iso("__end.date").alias(end), value.alias(target))


def target_report(targets: DataFrame, months: int) -> DataFrame:
    """Counts and exact, interpolated quantiles of a target table."""
    x, end = F.col(f"target_{months}m"), F.col(f"target_{months}m_end_date")
    q = F.percentile(x, [0.01, 0.5, 0.99])
    out = targets.agg(
        F.count("*").alias("n_rows"), F.count(x).alias("n_valid"), F.count_if(end.isNull()).alias("n_no_endpoint"), F.count_if(end.isNotNull() & x.isNull()).alias("n_broken"),
        F.avg(x).alias("mean"), q.alias("__q"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return out.select("n_rows", "n_valid", "n_no_endpoint", "n_broken", "mean", F.get("__q", F.lit(1)).alias("median"), F.get("__q", F.lit(0)).alias("p01"), F.get("__q", F.lit(2)).alias("p99"), "min", "max")
