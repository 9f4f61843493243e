"""Command lines that build the panels: python -m tessera.plans.build daily|monthly|quarterly|targets|dates ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from ..operators import panels, quality, targets
from ..session import session
from ..sources import io, schema


def build_daily(spark: SparkSession, source: str, outdir: str) -> DataFrame:
    """Extract, write the raw panel and the list of absent columns, clean, write; the report."""
    df = spark.read.parquet(source)
    io.write_panel(io.extract_columns(df, schema.DAILY_REQUESTED), f"{outdir}/daily_raw.parquet")
    io.missing_columns_csv(spark, f"{outdir}/missing_daily_columns.csv", schema.DAILY_REQUESTED, df.columns)
    raw = io.read_panel(spark, f"{outdir}/daily_raw.parquet")
    io.write_panel(quality.clean_daily(raw), f"{outdir}/daily_clean.parquet")
    return quality.clean_report(raw).crossJoin(quality.verify_clean(spark.read.parquet(f"{outdir}/daily_clean.parquet")))  # one row each


def build_monthly(spark: SparkSession, source: str, out: str) -> None:
    io.write_panel(panels.monthly_panel(io.read_panel(spark, source, schema.MONTHLY_COLUMNS)), out, "security_id", "date")


def build_quarterly(spark: SparkSession, source: str, out: str) -> DataFrame:
    columns = io.columns_of(spark, source)
    chosen = schema.quarterly_columns(columns)
    if absent := schema.missing(chosen, columns):
        raise ValueError(f"missing columns: {absent}")
    panel = panels.rebalance_panel(io.read_panel(spark, source, chosen))
    io.write_panel(quality.apply_do_not_use(panel), out, "security_id", "rebalance_date")
    return quality.do_not_use_report(panel)


def build_targets(spark: SparkSession, daily: str, outdir: str, return_unit: str = "fraction") -> list[DataFrame]:
    columns = io.columns_of(spark, daily)
    ids = schema.unique(["security_id", "ticker", *schema.existing(schema.TARGET_OPTIONAL, columns)])
    schema.require(spark.read.parquet(daily), schema.TARGET_REQUIRED)
    df = io.read_panel(spark, daily, schema.unique([*ids, "date", "equity_total_return"]))
    quality.validate_keys(df, schema.TARGET_REQUIRED)
    ends = targets.market_month_end(targets.return_state(df, return_unit, ids)).persist()
    reports = []
    try:
        for months, quarters, name in ((1, False, "monthly_targets"), (3, True, "quarterly_targets")):
            path = f"{outdir}/{name}.parquet"
            io.write_panel(targets.horizon_targets(ends, months, quarters), path, "date", "security_id")
            reports.append(targets.target_report(spark.read.parquet(path), months))
    finally:
        ends.unpersist()
    return reports


def standardise(spark: SparkSession, path: str, names: list[str], rename: dict[str, str] | None = None, units: dict[str, str] | None = None) -> None:
    """One kind of date in a panel, in place; running it again changes nothing."""
    io.rewrite_panel(spark, path, lambda df: panels.standardise_dates(df, names, {k: v for k, v in (rename or {}).items() if k in df.columns}, units))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, options in {"daily": ("input", "outdir"), "monthly": ("input", "out"), "quarterly": ("input", "out"), "targets": ("daily", "outdir"), "dates": ("path",)}.items():
        sub = kinds.add_parser(kind)
        for o in options:
            sub.add_argument(f"--{o}", required=True)
        if kind == "targets":
            sub.add_argument("--return-unit", choices=("fraction", "percent"), default="fraction")
        if kind == "dates":
            sub.add_argument("--columns", nargs="+", default=["date"])
            sub.add_argument("--rename", nargs="*", default=[], help="old=new")
            sub.add_argument("--units", nargs="*", default=[], help="column=s|ms|us|ns, of whole numbers since the epoch")
    args = parser.parse_args(argv)
    spark = session()
    if args.kind == "daily":
        build_daily(spark, args.input, args.outdir).show(vertical=True)
    elif args.kind == "monthly":
        build_monthly(spark, args.input, args.out)
    elif args.kind == "quarterly":
        build_quarterly(spark, args.input, args.out).show(1000, truncate=False)
    elif args.kind == "targets":
        for report in build_targets(spark, args.daily, args.outdir, args.return_unit):
            report.show(vertical=True)
    else:
        standardise(spark, args.path, args.columns, *(dict(x.split("=") for x in given) for given in (args.rename, args.units)))


if __name__ == "__main__":
    main()
