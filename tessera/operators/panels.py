"""Monthly and quarterly panels, and one kind of date for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import as_date, month_index, previous_quarter_end
from ..sources.io import with_row_id
from ..sources.schema import IDENTITY, MONTHLY_COLUMNS, MONTHLY_DATES, families, require
from .asof import asof_join, keep_last, null_where


def monthly_last(df: DataFrame, by: str = "security_id", date: str = "date") -> DataFrame:
    """An entity's own last row of each month; of equal dates the last row of the source."""
    day = as_date(df, date, strict=False)
    rows = with_row_id(df.withColumn("__day", day).where(F.col(by).isNotNull() & F.col("__day").isNotNull()).withColumn("__month", month_index("__day")), "__row")
    return keep_last(rows, [by, "__month"], F.col("__day").desc(), F.col("__row").desc()).drop("__day", "__month", "__row")


def monthly_panel(df: DataFrame) -> DataFrame:
    require(df, MONTHLY_COLUMNS)
    out = monthly_last(df.select(*MONTHLY_COLUMNS))
    return out.withColumns({c: as_date(out, c) for c in MONTHLY_DATES})


def rebalance_grid(df: DataFrame, by: str = "security_id", date: str = "date") -> DataFrame:
    """``by, rebalance_date, prev_q``: the quarter ends within each entity's own range of dates."""
    spans = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    spans = spans.where("__lo is not null")
    starts = F.expr("explode(sequence(cast(date_trunc('quarter', __lo) as date), __hi, interval 3 months))")
    ends = spans.select(by, "__lo", "__hi", starts.alias("__start")).withColumn("rebalance_date", F.last_day(F.add_months("__start", 2)))
    ends = ends.where("rebalance_date between __lo and __hi")
    return ends.select(by, "rebalance_date", previous_quarter_end("rebalance_date").alias("prev_q"))


def rebalance_panel(df: DataFrame, by: str = "security_id", date: str = "date") -> DataFrame:
    """What was known of each entity at each quarter end.

    Fundamentals and actuals: the latest announcement not after the quarter end, void if it was
    made before the previous quarter end (an entity's identity stays). Consensus: the latest
    statistic of the actual's own period not after its announcement, void without an actual.
    Of rows announced on one day the one with the latest ``date`` counts, then the source's last;
    an announcement may come with a row dated after the quarter end.
    """
    dates = {f.name: as_date(df, f.name) for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    df = with_row_id(df.withColumns(dates) if dates else df, "__row")
    family = families([c for c in df.columns if c != "__row"], (by, date))
    fund, act, cons = family["fundamentals"], family["actuals"], family["consensus"]
    latest = (F.col(date).desc_nulls_last(), F.col("__row").desc())
    # Each family is dealt by the entity once; de-duplication, unions and as-of windows keep to it.
    known = df.where(F.col(by).isNotNull())

    def dealt(told: str, columns: list[str]) -> DataFrame:
        return known.where(F.col(told).isNotNull()).select(*dict.fromkeys([by, date, "__row", *columns])).repartition(by)

    right = keep_last(dealt("announce_date", fund), [by, "announce_date"], *latest).select(by, *fund)
    out = asof_join(rebalance_grid(df, by, date), right, [by], "rebalance_date", "announce_date")
    out = null_where(out, F.col("announce_date") < F.col("prev_q"), [c for c in fund if c not in IDENTITY])

    right = keep_last(dealt("actuals_announce_date", act), [by, "actuals_announce_date"], *latest).select(by, *act)
    out = asof_join(out, right, [by], "rebalance_date", "actuals_announce_date")
    out = null_where(out, F.col("actuals_announce_date") < F.col("prev_q"), act)

    keys = [by, "consensus_forecast_period_end", "consensus_statistic_date"]
    right = keep_last(dealt("consensus_statistic_date", cons).dropna(subset=keys[1:]), keys, *latest).select(by, *cons).withColumn("__pe", F.col("consensus_forecast_period_end"))
    out = asof_join(out.withColumn("__pe", F.col("actuals_period_end")), right, [by, "__pe"], "actuals_announce_date", "consensus_statistic_date")
    out = null_where(out, F.col("actuals_actual_eps").isNull(), cons)
    return out.select(by, "rebalance_date", *fund, *act, *cons)


def standardise_dates(df: DataFrame, names: list[str], rename: dict[str, str] | None = None, units: dict[str, str] | None = None) -> DataFrame:
    """Dates of any kind as UTC calendar days, columns renamed first; ``units`` says what whole
    numbers count (see ``as_date``)."""
    df = df.withColumnsRenamed(rename or {})
    return df.withColumns({c: as_date(df, c, unit=(units or {}).get(c)) for c in names})
