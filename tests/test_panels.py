"""Hand-computed cases of the panel operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.functions import rank as K
from tessera.functions import window as W
from tessera.operators import asof, panels, quality, targets
from tessera.plans import build
from tessera.sources import io, schema

INF, NAN = float("inf"), float("nan")


def day(text):
    return dt.date.fromisoformat(text)


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def series(spark, values, kind="double"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"security_id string, date int, x {kind}")


def close(got, want):
    return all((a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-12)) for a, b in zip(got, want, strict=True))


def test_missing_values_and_ratios(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 5.0), (2, 1.0, None), (3, 1.0, INF), (4, None, 2.0), (5, NAN, 2.0), (6, INF, 1.0)], "i int, a double, b double")
    assert column(df.select("i", X.safe_divide("a", "b").alias("q")), "q", "i") == [None, 0.0, None, 0.0, None, None, INF]
    assert column(X.nan_to_null(df), "a", "i")[5] is None
    assert column(df.select("i", X.finite("a").alias("f")), "f", "i") == [True] * 4 + [False] * 3
    strings = spark.createDataFrame([(0, "1.5"), (1, "no"), (2, None)], "i int, s string")
    assert column(strings.select("i", X.number("s").alias("n")), "n", "i") == [1.5, None, None]
    with pytest.raises(ValueError):
        X.scaled_return("x", "bp")


def test_r1(spark):
    rows = [(10, 11, 9, 10, False), (10, 9, 11, 10, True), (12, 11, 9, 10, True), (11, 11, 9, 9, False), (12, 11, 9, None, False), (12, 11, 9, INF, False), (12, 11, 9, NAN, False)]
    df = spark.createDataFrame([(i, *(None if v is None else float(v) for v in r[:4]), r[4]) for i, r in enumerate(rows)], "i int, equity_open_raw double, equity_high_raw double, equity_low_raw double, equity_close_raw double, want boolean")
    assert column(df.select("i", quality.r1_mask().alias("r1")), "r1", "i") == [r[4] for r in rows]


def test_r3(spark):
    rows = [(50.0, 2.0, 100.0, False), (50.25, 2.0, 100.0, False), (50.26, 2.0, 100.0, True), (50.0, 2.0, 0.0, False), (None, 2.0, 100.0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, equity_adj_close double, equity_price_adj_factor double, equity_close_raw double, want boolean")
    assert column(df.select("i", quality.r3_mask().alias("r3")), "r3", "i") == [r[3] for r in rows]


def panel(spark, rows):
    full = [(s, day(d) if d else None, 1.0, 2.0, 1.0, 1.5, adj, 1.0, ret, raw) for s, d, adj, ret, raw in rows]
    df = spark.createDataFrame(full, "security_id string, date date, equity_open_raw double, equity_high_raw double, equity_low_raw double, c double, equity_adj_close double, equity_price_adj_factor double, equity_price_return_ex_div double, equity_close_raw double")
    return df.drop("c")


def test_r2_and_cleaning(spark):
    rows = [
        ("a", "2020-01-01", 100.0, None, 100.0), ("a", "2020-01-02", 101.0, 0.0104, 101.0), ("b", "2020-01-01", 100.0, None, 100.0), ("b", "2020-01-02", 101.0, 0.0106, 101.0),
        ("c", "2020-01-01", 100.0, 0.5, 100.0), ("c", "2020-01-03", 101.0, 0.5, 101.0), ("d", "2020-01-01", 0.0, None, 100.0), ("d", "2020-01-02", 101.0, 0.5, 101.0),
        (None, "2020-01-01", 100.0, None, 100.0), (None, "2020-01-02", 101.0, 0.5, 101.0), ("e", None, 100.0, 0.5, 100.0),
    ]
    df = panel(spark, rows).coalesce(1).withColumn("equity_high_raw", F.lit(200.0))
    got = {(r.security_id, r.date) for r in quality.with_r2(df).where("r2").collect()}
    assert got == {("b", day("2020-01-02"))}
    cleaned = quality.clean_daily(df)
    assert cleaned.columns == df.columns
    assert {(r.security_id, r.equity_price_return_ex_div) for r in cleaned.where("date = '2020-01-02' and security_id in ('a', 'b')").collect()} == {("a", 0.0104), ("b", None)}
    report = quality.clean_report(df).first()
    assert (report.input_rows, report.r1_rows, report.r2_rows, report.r2_emptied) == (11, 0, 1, 1) and report.r3_rows == report.deleted_rows == 1
    assert quality.verify_clean(cleaned).first() == (0, 0)
    with pytest.raises(ValueError):
        quality.clean_daily(df.drop("equity_adj_close"))


def test_lags_and_trailing_sum(spark):
    df = series(spark, [10.0, None, 30.0])
    assert column(df.select("date", W.group_shift("x", 1).alias("y")), "y", "date") == [None, 10.0, None]
    assert column(df.select("date", W.group_shift("x", -1).alias("y")), "y", "date") == [None, 30.0, None]
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, None, None, 8.0])
    assert close(column(df.select("date", W.ttm("x", order="date").alias("y")), "y", "date"), [None, None, None, 28 / 3, 44 / 3, None, None, None])
    nobody = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], "security_id string, date int, x double")
    assert column(nobody.select("date", W.lag_1m("x").alias("y")), "y", "date") == [None, None]
    infinite = series(spark, [1.0, INF, 3.0, 5.0])
    assert column(infinite.select("date", W.ttm("x", order="date").alias("y")), "y", "date")[3] == 12.0


def test_one_exchange_for_all_columns_of_a_window(spark):
    plan = series(spark, [1.0]).repartition(2).select("date", W.lag_1m("x"), W.lag_3m("x"), W.ttm("x", order="date"), K.rolling_ts_rank("x", 5, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_scores(spark):
    df = series(spark, [1.0, 1.0, None, 3.0, INF, NAN]).withColumn("g", F.lit(1))
    assert close(column(K.score(df, "x", "g"), "score", "date"), [-0.125, -0.125, None, 0.25, 0.5, None])
    df = series(spark, [1.0, 2.0]).withColumn("g", F.lit(1))
    assert column(K.score(df, "x", "g"), "score", "date") == [0.0, 0.5] and column(K.score_low(df, "x", "g"), "score_low", "date") == [0.5, 0.0]
    for n, ties in ((100, 1), (101, 2), (300, 3)):
        df = series(spark, [float(i) for i in range(n)]).withColumn("g", F.lit(1))
        got = column(K.score(df, "x", "g"), "score", "date")
        assert close(got[:ties], [(ties + 1) / 2 / n - 0.5] * ties) and got[ties] > got[0]
        low = column(K.score_low(df, "x", "g"), "score_low", "date")
        assert close(low, [1 / n - s for s in got])


def test_rolling_rank(spark):
    cases = [([1, 2, 2], [None, None, 0.25]), ([3, 3, 3], [None] * 3), ([1, 2, None, 4], [None, None, None, 0.5]), ([1, 5], [None, None]), ([1, 2, INF, 0], [None, None, None, -0.5])]
    for values, want in cases:
        df = series(spark, [None if v is None else float(v) for v in values])
        assert column(df.select("date", K.rolling_ts_rank("x", 5, 2).alias("y")), "y", "date") == want


def test_asof(spark):
    right = spark.createDataFrame([("a", day("2020-01-02"), 1, 1, "p"), ("a", day("2020-01-02"), 2, 2, None), ("a", day("2020-01-06"), 3, 3, "q"), (None, day("2020-01-01"), 4, 9, "n")], "k string, told date, row int, v int, w string")
    right = asof.keep_last(right, ["k", "told"], F.col("row").desc()).drop("row")
    left = spark.createDataFrame([("a", day("2020-01-01")), ("a", day("2020-01-02")), ("a", day("2020-01-05")), ("a", day("2020-01-07")), ("b", day("2020-01-07")), (None, day("2020-01-07")), ("a", None)], "k string, at date")
    got = {(r.k, r.at): (r.v, r.w) for r in asof.asof_join(left, right, ["k"], "at", "told").collect()}
    none = (None, None)
    assert got == {("a", day("2020-01-01")): none, ("a", day("2020-01-02")): (2, None), ("a", day("2020-01-05")): (2, None), ("a", day("2020-01-07")): (3, "q"), ("b", day("2020-01-07")): none, (None, day("2020-01-07")): none, ("a", None): none}


def quarter_rows(spark, rows):
    kinds = "security_id string, date date, announce_date date, ticker string, total_assets double, actuals_period_end date, actuals_announce_date date, actuals_actual_eps double, consensus_forecast_period_end date, consensus_statistic_date date, consensus_eps_mean double"
    return spark.createDataFrame([tuple(day(v) if isinstance(v, str) and v[:2] == "20" else v for v in r) for r in rows], kinds).coalesce(1)


def test_rebalance_guards_and_consensus(spark):
    rows = [
        ("keep", "2020-03-31", "2020-03-31", "K", 1.0, "2020-03-31", "2020-05-01", 0.5, "2020-03-31", "2020-04-20", 10.0),
        ("keep", "2020-04-30", None, "K", None, None, None, None, "2020-03-31", "2020-05-01", 11.0),
        ("keep", "2020-05-31", None, "K", None, None, None, None, "2020-03-31", "2020-05-02", 12.0),
        ("keep", "2020-06-30", None, "K", None, None, None, None, "2020-06-30", "2020-04-30", 13.0),
        ("old", "2020-03-01", "2020-03-30", "O", 2.0, "2019-12-31", "2020-03-30", 0.5, "2019-12-31", "2020-01-01", 10.0),
        ("old", "2020-06-30", None, "O", None, None, None, None, None, None, None),
        ("none", "2020-06-01", "2020-07-15", "N", 3.0, "2020-03-31", "2020-06-15", None, "2020-03-31", "2020-06-01", 10.0),
        ("none", "2020-06-30", None, "N", None, None, None, None, None, None, None),
    ]
    got = {(r.security_id, str(r.rebalance_date)): r for r in panels.rebalance_panel(quarter_rows(spark, rows)).collect()}
    june = got["keep", "2020-06-30"]
    assert (june.total_assets, june.ticker, june.actuals_actual_eps, june.consensus_eps_mean) == (1.0, "K", 0.5, 11.0)
    old = got["old", "2020-06-30"]
    assert (old.total_assets, old.ticker, old.announce_date, old.actuals_actual_eps, old.consensus_eps_mean) == (None, "O", None, None, None)
    none = got["none", "2020-06-30"]
    assert (none.total_assets, none.ticker, none.actuals_announce_date, none.consensus_eps_mean) == (None, None, day("2020-06-15"), None)
    assert ("keep", "2020-03-31") in got and len(got) == 5


def test_do_not_use(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, 2.0, 3.0, 1, 5.0, True, True), (2, 1.0, None, 2.0, 3.0, 2, 5.0, False, False), (3, 1.0, False, 2.0, 3.0, None, 5.0, True, None)],
        "i int, total_assets double, total_assets_dnu_flag boolean, operating_cash_flow_ytd double, ocf_increment double, ocf_dnu_flag int, abc_x double, abc_y_flag boolean, abc_dnu_flag boolean",
    )
    out = quality.apply_do_not_use(df)
    assert out.columns == ["i", "total_assets", "operating_cash_flow_ytd", "ocf_increment", "abc_x", "abc_y_flag"]
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, None, None, None, None, True), (2, 1.0, 2.0, 3.0, 5.0, False), (3, 1.0, 2.0, 3.0, 5.0, True)]
    assert {r.flag: r.hits for r in quality.do_not_use_report(df).collect()} == {"total_assets_dnu_flag": 1, "ocf_dnu_flag": 1, "abc_dnu_flag": 1}


DATES = ["2021-01-30", "2021-01-31", "2021-02-03", "2021-02-28", "2021-03-31"]


def returns(spark):
    a = dict(zip(DATES, [0.01, 0.02, 0.10, -0.05, 0.03]))
    rows = [("A", d, r) for d, r in a.items()] + [("B", d, 0.01) for d in DATES if d != "2021-02-03"]
    rows += [("C", d, 0.01) for d in DATES if d != "2021-02-28"] + [("D", d, -1.0 if d == "2021-02-03" else 0.01) for d in DATES]
    return spark.createDataFrame([(s, "t", day(d), r) for s, d, r in rows], "security_id string, ticker string, date date, equity_total_return double")


def test_targets(spark):
    ends = targets.market_month_end(targets.return_state(returns(spark)))
    got = {(r.security_id, r.date): (r.target_1m, r.target_1m_end_date) for r in targets.horizon_targets(ends, 1).collect()}
    assert math.isclose(got["A", "2021-01-31"][0], 1.10 * 0.95 - 1) and got["A", "2021-01-31"][1] == "2021-02-28"
    assert math.isclose(got["A", "2021-02-28"][0], 0.03) and got["A", "2021-03-31"] == (None, None)
    assert got["B", "2021-01-31"] == (None, "2021-02-28") and got["B", "2021-02-28"][0] is not None
    assert got["C", "2021-01-31"] == (None, None) and ("C", "2021-02-28") not in got
    assert got["D", "2021-01-31"] == (None, "2021-02-28")
    three = targets.horizon_targets(ends, 3, True).collect()
    assert {r.date for r in three} == {"2021-03-31"} and all(r.target_3m is None for r in three)
    per_cent = targets.return_state(returns(spark).withColumn("equity_total_return", F.lit(1.0)), "percent")
    assert math.isclose(per_cent.where("security_id = 'A' and date = '2021-01-31'").first().cum_log_return, math.log1p(0.01))
    monthly = panels.monthly_last(returns(spark)).where("security_id = 'C' and month(date) = 2").first()
    assert monthly.date == day("2021-02-03")  # its own last day, which is not the market's


def test_three_months_are_three_single_months(spark):
    dates = [day("2020-01-01") + dt.timedelta(days=i) for i in range(200)]
    df = spark.createDataFrame([("A", "t", d, ((i * 37) % 11 - 5) / 100) for i, d in enumerate(dates)], "security_id string, ticker string, date date, equity_total_return double")
    ends = targets.market_month_end(targets.return_state(df))
    one = {r.date: r.target_1m for r in targets.horizon_targets(ends, 1).collect()}
    for r in targets.horizon_targets(ends, 3, True).where("target_3m is not null").collect():
        later = [d for d in sorted(one) if d >= r.date][:3]
        assert math.isclose(1 + r.target_3m, math.prod(1 + one[d] for d in later))


def test_validation(spark):
    good = returns(spark)
    quality.validate_keys(good, schema.TARGET_REQUIRED)
    with pytest.raises(ValueError, match="1 duplicate"):
        quality.validate_keys(good.union(good.limit(1)), schema.TARGET_REQUIRED)
    with pytest.raises(ValueError, match="1 invalid"):
        quality.validate_keys(good.union(good.limit(1).withColumn("date", F.lit(None).cast("date"))), schema.TARGET_REQUIRED)
    with pytest.raises(ValueError, match="missing columns"):
        quality.validate_keys(good.drop("ticker"), schema.TARGET_REQUIRED)


def test_dates(spark):
    df = spark.createDataFrame([("2020-03-31T23:30:00-05:00", 1585612800000, 1585612800000000000, "x")], "s string, ms long, ns long, bad string")
    r = panels.standardise_dates(df, ["s", "ms", "ns"]).first()
    assert (r.s, r.ms, r.ns) == (day("2020-04-01"), day("2020-03-31"), day("2020-03-31"))
    assert df.select(X.as_date(df, "bad", strict=False).alias("d")).first().d is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be"):
        panels.standardise_dates(df, ["bad"]).collect()


def test_column_selection():
    assert schema.existing(["a", "b", "a", "z"], ["b", "a", "c"]) == ["a", "b"]
    assert schema.missing(["a", "b", "a", "z"], ["b", "a", "c"]) == ["z"]
    source = schema.QUARTERLY_KEYS_META + schema.QUARTERLY_ACCOUNTS + ["revenue_x_flag", "revenue_imputed_flag", "actuals_eps_outlier_flag", "actuals_q_flag", "rec_x_flag", "consensus_q_flag"]
    chosen = schema.quarterly_columns(source)
    assert {"revenue_x_flag", "actuals_q_flag", "consensus_q_flag", "ocf_dnu_flag"} <= set(chosen) and not {"revenue_imputed_flag", "actuals_eps_outlier_flag", "rec_x_flag"} & set(chosen)
    assert len(chosen) == len(set(chosen)) and "ocf_dnu_flag" in schema.quarterly_report(source)["missing"]
    assert len(schema.DAILY_REQUESTED) == 32 and len(schema.MONTHLY_COLUMNS) == 25


def test_builders(spark, tmp_path):
    source, out = str(tmp_path / "wide.parquet"), str(tmp_path / "out")
    rows = [("a", d, 100.0 + i) for i, d in enumerate(DATES)] + [("a", "2021-04-30", 200.0)]
    df = spark.createDataFrame([(s, day(d), 1.0, 300.0, 0.5, p, p, 1.0, None, 0.01, "T", False) for s, d, p in rows], "security_id string, date date, equity_open_raw double, equity_high_raw double, equity_low_raw double, equity_close_raw double, equity_adj_close double, equity_price_adj_factor double, equity_price_return_ex_div double, equity_total_return double, ticker string, equity_odd_flag boolean")
    df.write.parquet(source)
    report = build.build_daily(spark, source, out).first()
    assert report.input_rows == 6 and report.r1_left == report.r3_left == 0
    text = open(f"{out}/missing_daily_columns.csv", "rb").read()
    assert text.startswith(b"\xef\xbb\xbfmissing_column\ncompany_id\n")
    assert "equity_odd_flag" in io.columns_of(spark, f"{out}/daily_clean.parquet")
    reports = build.build_targets(spark, f"{out}/daily_clean.parquet", out)
    assert reports[0].first().n_rows == 4 and spark.read.parquet(f"{out}/quarterly_targets.parquet").count() == 1
    spark.createDataFrame([(1, 1585612800000)], "i int, rebalance_date long").write.parquet(f"{out}/q.parquet")
    for _ in range(2):
        build.standardise(spark, f"{out}/q.parquet", ["date"], {"rebalance_date": "date"})
        assert spark.read.parquet(f"{out}/q.parquet").first().date == day("2020-03-31")
    monthly = str(tmp_path / "m.parquet")
    spark.range(1).select(*[F.lit(day("2021-02-03") if c in schema.MONTHLY_DATES else 1.0).alias(c) for c in schema.MONTHLY_COLUMNS]).write.parquet(monthly)
    build.build_monthly(spark, monthly, f"{out}/monthly.parquet")
    assert spark.read.parquet(f"{out}/monthly.parquet").columns == schema.MONTHLY_COLUMNS


def test_build_quarterly(spark, tmp_path):
    source, out = str(tmp_path / "wide.parquet"), str(tmp_path / "q.parquet")
    names = schema.quarterly_columns([])
    dates = {"date", "report_date", "announce_date", "actuals_period_end", "actuals_announce_date", "consensus_statistic_date", "consensus_forecast_period_end"}
    value = lambda c: day("2020-03-31") if c in dates else "A" if c in ("security_id", *schema.IDENTITY) else c == "ocf_dnu_flag" if c.endswith("_flag") else 1.0
    spark.range(1).select(*[F.lit(value(c)).alias(c) for c in names]).write.parquet(source)
    report = {r.flag: r.hits for r in build.build_quarterly(spark, source, out).collect()}
    row = spark.read.parquet(out).first()
    assert report == {"ocf_dnu_flag": 1, "capex_dnu_flag": 0} and row.operating_cash_flow_ytd is None and row.capex_ytd == 1.0 and "ocf_dnu_flag" not in row


def test_whole_numbers_of_any_unit(spark):
    per = X.PER_DAY
    for unit, n in per.items():
        values = [0, 1, n - 1, n, -1, -n, -n - 1, 5 * n + n // 2]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, n long")
        got = column(df.select("i", X.as_date(df, "n", unit=unit).alias("d")), "d", "i")
        assert got == [dt.date(1970, 1, 1) + dt.timedelta(days=v // n) for v in values], unit
    last = spark.createDataFrame([(1577923199999999999,)], "n long")  # a nanosecond before 2020-01-02
    assert last.select(X.as_date(last, "n").alias("d")).first().d == day("2020-01-01")


def test_ts_rank_gathers_once(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    plan = df.select(K.rolling_ts_rank("x", 2, 1).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_ties_have_an_order(spark):
    df = spark.createDataFrame([("a", 1, 3, 30.0), ("a", 1, 1, 10.0), ("a", 1, 2, 20.0), ("a", 2, 0, 40.0)], "security_id string, date int, row int, x double").repartition(3)
    assert column(df.select("date", "row", W.group_shift("x", 1, ties=["row"]).alias("l")), "l", ["date", "row"]) == [None, 10.0, 20.0, 30.0]
    assert column(df.select("date", "row", W.rolling_sum_4q("x", order="date", ties=["row"]).alias("l")), "l", ["date", "row"]) == [None, None, None, 100.0]


def test_repeated_month_ends_raise(spark):
    rows = [("a", "t", day("2020-01-31"), 24241, 0.0, 0), ("a", "t", day("2020-01-31"), 24241, 0.5, 0), ("b", "t", day("2020-01-31"), 24241, 0.0, 0)]
    ends = spark.createDataFrame(rows, "security_id string, ticker string, date date, month int, cum_log_return double, cum_invalid long")
    with pytest.raises(Exception, match="several rows at a month end of security a"):
        targets.horizon_targets(ends, 1).collect()
    assert targets.horizon_targets(ends.where("cum_log_return = 0"), 1).count() == 2


def test_rewrite_puts_back(spark, tmp_path):
    path = f"{tmp_path}/panel"
    spark.range(3).write.parquet(path)
    with pytest.raises(ZeroDivisionError):
        io.rewrite_panel(spark, path, lambda df: 1 / 0)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "panel").rename(tmp_path / "panel.old-1234abcd")  # as if the program had ended between the two steps
    io.rewrite_panel(spark, path, lambda df: df.where("id > 0"))
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("panel")] == ["panel"]


def test_csv_on_any_file_system(spark, tmp_path):
    io.missing_columns_csv(spark, f"file://{tmp_path}/deep/er/missing.csv", ["a", "ü", "b"], ["a"])
    assert (tmp_path / "deep/er/missing.csv").read_bytes() == "missing_column\nü\nb\n".encode("utf-8-sig")


def test_flags_by_family():
    names = ["net_ppe_flag", "net_ppe_x_dnu_flag", "consensus_a_flag", "actuals_eps_outlier_flag", "revenue_imputed_flag", "revenue", "other_flag", "revenues_flag", "actuals_b_flag", "inventory_flag_note"]
    assert [schema.flag_family(c) for c in names] == ["accounts", "accounts", "consensus", None, None, None, None, None, "actuals", None]
    assert quality.do_not_use_targets(["x_a", "x_b_flag", "x_dnu_flag", "y", "y_z", "y_dnu_flag", "capex_increment", "capex_dnu_flag", "q_dnu_flag"]) == {"x_dnu_flag": ["x_a"], "y_dnu_flag": ["y"], "capex_dnu_flag": ["capex_increment"], "q_dnu_flag": []}


def test_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int").repartition(4)
    io.write_panel(df, f"{tmp_path}/p", "a", "b")
    rows = [tuple(r) for path in sorted((tmp_path / "p").glob("*.parquet")) for r in spark.read.parquet(str(path)).collect()]
    assert rows == sorted(rows) and len(rows) == 50


def test_bench_goes_on_after_an_error(monkeypatch, capsys, spark):
    import json

    import bench

    monkeypatch.setattr(bench.entry_points, "queries", lambda: {"bad": lambda s, d: 1 / 0, "good": lambda s, d: s.range(3)})
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    with pytest.raises(SystemExit) as end:
        bench.main([])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert end.value.code == 1 and list(out["queries"]) == ["good"] and "ZeroDivisionError" in out["errors"]["bad"]
