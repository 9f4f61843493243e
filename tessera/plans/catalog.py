"""Registered panel queries over the driver's tables, and the SQL each must match.

Base frames are SQL that Spark and DuckDB both read; an operator's query applies our operator to
the base frame in Spark, its oracle spells the same result out in plain SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import rank as K
from ..functions import window as W
from ..operators import asof, panels, quality, targets
from ..sources import io, schema
from . import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TABLE = re.compile(r"\{(\w+)\}")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def duck(text: str) -> str:
    return _TABLE.sub(lambda m: m[1], text)


def iso(df: DataFrame) -> DataFrame:
    """Dates as ISO strings, which every engine writes alike."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema])


def steady(c):
    """Six decimals by floor, which rounds alike in every engine."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def steady_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def query(name: str, base: str, oracle: str):
    """Registers ``f(frame)``; ``oracle`` may name the base frame as b."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: iso(f(sql(spark, sf_dir, base)))
        ORACLE_SQL[name] = f"WITH b AS ({duck(base)})\n{duck(oracle)}"
        return f

    return register


# Base frames ---------------------------------------------------------------------------------

#: Six entities by day, present on nearly all market days, with prices that break each rule.
DAILY = """
SELECT security_id, ticker, date, lo AS equity_open_raw, CASE WHEN n % 7 = 0 THEN hi * 0.5e0 ELSE hi END AS equity_high_raw,
  lo AS equity_low_raw, CASE WHEN n % 13 = 0 THEN NULL ELSE hi END AS equity_close_raw, factor AS equity_price_adj_factor,
  adj AS equity_adj_close, total AS equity_total_return,
  adj / lag(adj) OVER (PARTITION BY security_id ORDER BY date) - 1e0 + CASE WHEN n % 5 = 0 THEN 1e-2 ELSE 0e0 END AS equity_price_return_ex_div,
  n AS equity_volume_raw, n % 2 = 0 AS equity_close_flag
FROM (
  SELECT *, hi / factor * CASE WHEN n % 11 = 0 THEN 1.02e0 ELSE 1e0 END AS adj FROM (
    SELECT concat(l_returnflag, l_linestatus) AS security_id, concat('T', l_returnflag) AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
      count(*) AS n, CAST(1 + count(*) % 3 AS DOUBLE) AS factor, CASE WHEN count(*) % 37 = 0 THEN NULL ELSE (max(l_discount) - max(l_tax)) / 10e0 END AS total
    FROM {lineitem} GROUP BY 1, 2, 3) x) y
"""
#: Suppliers by day, mostly absent.
SUPPLIER_DAY = """
SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS price, max(l_quantity) AS quantity, min(l_discount) AS discount, count(*) AS n
FROM {lineitem} GROUP BY 1, 2
"""
#: Suppliers by month and by quarter.
SUPPLIER_MONTH = "SELECT l_suppkey AS security_id, CAST(date_trunc('month', CAST(l_shipdate AS TIMESTAMP)) AS DATE) AS date, max(l_extendedprice) AS price, CASE WHEN (l_suppkey + count(*)) % 9 = 0 THEN NULL ELSE max(l_quantity) END AS quantity FROM {lineitem} GROUP BY 1, 2"
SUPPLIER_QUARTER = "SELECT l_suppkey AS security_id, CAST(date_trunc('quarter', CAST(l_shipdate AS TIMESTAMP)) AS DATE) AS rebalance_date, max(l_extendedprice) AS x, count(*) AS n FROM {lineitem} GROUP BY 1, 2"
#: Customers by quarter, with holes; groups are large enough for winsorising to bite.
CUSTOMER_QUARTER = """
SELECT o_custkey AS security_id, CAST(date_trunc('quarter', CAST(o_orderdate AS TIMESTAMP)) AS DATE) AS rebalance_date,
  CASE WHEN o_custkey % 11 = 3 THEN NULL ELSE max(o_totalprice) END AS total_assets, max(o_totalprice) - 1000e0 AS book_equity, min(o_totalprice) AS inventory, count(*) AS n
FROM {orders} GROUP BY 1, 2
"""
EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM {events}"
LINES = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}"


# Columns and missing values --------------------------------------------------------------------


@query("select_existing", "SELECT * FROM {lineitem}", "SELECT l_orderkey, l_tax, l_quantity FROM b")
def _(df):
    return schema.select_existing(df, ["l_orderkey", "nowhere", "l_tax", "l_orderkey", "l_quantity"])


@query("extract_with_flags", DAILY, "SELECT CAST(date AS VARCHAR) AS date, security_id, ticker, equity_open_raw, equity_high_raw, equity_low_raw, equity_close_raw, equity_volume_raw, equity_adj_close, equity_total_return, equity_price_adj_factor, equity_close_flag FROM b")
def _(df):
    return io.extract_columns(df.drop("equity_price_return_ex_div"), schema.DAILY_REQUESTED)


@query("missing_columns", "SELECT * FROM {lineitem}", "SELECT unnest(['date', 'security_id']) AS missing_column")
def _(df):
    return io.missing_columns(df.sparkSession, ["l_tax", "date", "security_id"], df.columns)


@query("safe_divide", LINES, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS per_tax FROM b")
def _(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", X.safe_divide("l_tax", "l_discount").alias("ratio"), X.safe_divide("l_quantity", "l_tax").alias("per_tax"))


@query("market_cap", "SELECT p_partkey, p_retailprice AS equity_close_raw, CAST(p_size AS DOUBLE) AS equity_shares_outstanding_k FROM {part}", "SELECT p_partkey, equity_close_raw * equity_shares_outstanding_k / 1000e0 AS market_cap FROM b")
def _(df):
    return df.select("p_partkey", X.market_cap_mn().alias("market_cap"))


@query(
    "missing_ratio", CUSTOMER_QUARTER,
    f"SELECT {steady_sql('avg(CASE WHEN total_assets IS NULL THEN 1e0 ELSE 0e0 END)')} AS total_assets, {steady_sql('avg(CASE WHEN n IS NULL THEN 1e0 ELSE 0e0 END)')} AS n FROM b",
)
def _(df):
    return quality.missing_ratio(df, ["total_assets", "n"]).select(steady(F.col("total_assets")).alias("total_assets"), steady(F.col("n")).alias("n"))


# Quality rules -----------------------------------------------------------------------------------

_R1 = "coalesce(equity_high_raw < equity_low_raw OR equity_open_raw > equity_high_raw OR equity_open_raw < equity_low_raw OR equity_close_raw > equity_high_raw OR equity_close_raw < equity_low_raw, false) AND equity_close_raw IS NOT NULL AND equity_high_raw IS NOT NULL"
_R3 = "coalesce(equity_close_raw > 0 AND abs(equity_adj_close * equity_price_adj_factor - equity_close_raw) > 1e-2 + 5e-3 * abs(equity_close_raw), false)"
_MASKS = f"""
, cal AS (SELECT date AS d, lag(date) OVER (ORDER BY date) AS prev_market FROM (SELECT DISTINCT date FROM b) z),
w AS (
  SELECT b.*, prev_market, lag(date) OVER s AS prev_date, lag(equity_adj_close) OVER s AS prev_adj FROM b JOIN cal ON date = d
  WINDOW s AS (PARTITION BY security_id ORDER BY date)),
m AS (
  SELECT *, {_R1} AS r1, {_R3} AS r3,
    coalesce(prev_date = prev_market AND equity_adj_close > 0 AND prev_adj > 0 AND abs(equity_price_return_ex_div - (equity_adj_close / prev_adj - 1e0)) > 5e-4, false) AS r2 FROM w)
"""


@query("r1_mask", DAILY, f"SELECT security_id, CAST(date AS VARCHAR) AS date, {_R1} AS r1 FROM b")
def _(df):
    return df.select("security_id", "date", quality.r1_mask().alias("r1"))


@query("r3_mask", DAILY, f"SELECT security_id, CAST(date AS VARCHAR) AS date, {_R3} AS r3 FROM b")
def _(df):
    return df.select("security_id", "date", quality.r3_mask().alias("r3"))


@query("r2_mask", DAILY, _MASKS + "SELECT security_id, CAST(date AS VARCHAR) AS date, r2 FROM m")
def _(df):
    return quality.with_r2(df).select("security_id", "date", "r2")


_CLEAN = "SELECT security_id, CAST(date AS VARCHAR) AS date, equity_high_raw, equity_adj_close, equity_total_return, CASE WHEN r2 THEN NULL ELSE equity_price_return_ex_div END AS equity_price_return_ex_div FROM m WHERE NOT (r1 OR r3)"


@query("clean_daily", DAILY, _MASKS + _CLEAN)
def _(df):
    return quality.clean_daily(df).select("security_id", "date", "equity_high_raw", "equity_adj_close", "equity_total_return", "equity_price_return_ex_div")


@query(
    "clean_report", DAILY,
    _MASKS + """SELECT count(*) AS input_rows, CAST(13 AS BIGINT) AS input_columns, count(*) FILTER (r1) AS r1_rows, count(*) FILTER (r2) AS r2_rows, count(*) FILTER (r3) AS r3_rows,
      count(*) FILTER (r1 AND r3) AS r1_and_r3, count(*) FILTER (r1 OR r3) AS deleted_rows, count(*) FILTER (r2 AND (r1 OR r3)) AS r2_deleted, count(*) FILTER (r2 AND NOT (r1 OR r3)) AS r2_emptied FROM m""",
)
def _(df):
    return quality.clean_report(df)


@query("verify_clean", DAILY, "SELECT CAST(0 AS BIGINT) AS r1_left, CAST(0 AS BIGINT) AS r3_left")
def _(df):
    return quality.verify_clean(quality.clean_daily(df))


@query("calendar_rank", LINES.replace("l_tax FROM", "l_tax, CAST(l_shipdate AS DATE) AS date FROM"), "SELECT CAST(date AS VARCHAR) AS market_date, CAST(lag(date) OVER (ORDER BY date) AS VARCHAR) AS prev_market, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS date_rank FROM (SELECT DISTINCT date FROM b) x")
def _(df):
    return quality.market_calendar(df).drop("next_market")


@query("duplicate_count", LINES, "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM b GROUP BY l_orderkey, l_linenumber) x")
def _(df):
    return quality.duplicate_count(df, ["l_orderkey", "l_linenumber"])


_FLAGGED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS total_assets, l_extendedprice AS operating_cash_flow_ytd, l_tax AS ocf_increment, l_discount AS margin_gross, l_tax * 2e0 AS margin_net,
  l_orderkey % 3 = 0 AS total_assets_dnu_flag, CASE WHEN l_orderkey % 5 = 0 THEN 1e0 WHEN l_orderkey % 5 = 1 THEN 2e0 ELSE NULL END AS ocf_dnu_flag,
  CASE WHEN l_linenumber = 2 THEN true WHEN l_linenumber = 3 THEN NULL ELSE false END AS margin_dnu_flag, l_linenumber = 2 AS margin_gross_flag, 'True' AS odd_dnu_flag
FROM {lineitem}
"""


@query(
    "apply_dnu", _FLAGGED,
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE total_assets END AS total_assets,
      CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE operating_cash_flow_ytd END AS operating_cash_flow_ytd, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE ocf_increment END AS ocf_increment,
      CASE WHEN l_linenumber = 2 THEN NULL ELSE margin_gross END AS margin_gross, CASE WHEN l_linenumber = 2 THEN NULL ELSE margin_net END AS margin_net, margin_gross_flag FROM b""",
)
def _(df):
    return quality.apply_do_not_use(df)


@query(
    "dnu_report", _FLAGGED,
    """SELECT 'total_assets_dnu_flag' AS flag, 'total_assets' AS targets, count(*) FILTER (l_orderkey % 3 = 0) AS hits FROM b
    UNION ALL SELECT 'ocf_dnu_flag', 'operating_cash_flow_ytd,ocf_increment', count(*) FILTER (l_orderkey % 5 = 0) FROM b
    UNION ALL SELECT 'margin_dnu_flag', 'margin_gross,margin_net', count(*) FILTER (l_linenumber = 2) FROM b
    UNION ALL SELECT 'odd_dnu_flag', '', CAST(0 AS BIGINT)""",
)
def _(df):
    return quality.do_not_use_report(df).withColumn("targets", F.array_join("targets", ","))


# Lags, trailing sums, averages ---------------------------------------------------------------------


@query("group_shift", EVENTS, "SELECT event_id, lag(value, 2) OVER w AS two_back, lead(value, 1) OVER w AS next_one FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def _(df):
    return df.select("event_id", W.group_shift("value", 2, "user_id", "ts").alias("two_back"), W.group_shift("value", -1, "user_id", "ts").alias("next_one"))


@query("quarter_lags", CUSTOMER_QUARTER, "SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, lag(total_assets) OVER w AS lag1, lag(total_assets, 4) OVER w AS lag4, lag(total_assets, 2) OVER w AS lag2 FROM b WINDOW w AS (PARTITION BY security_id ORDER BY rebalance_date)")
def _(df):
    return df.select("security_id", "rebalance_date", W.lag_1q("total_assets").alias("lag1"), W.lag_4q("total_assets").alias("lag4"), W.lag_nq("total_assets", 2).alias("lag2"))


@query("month_lags", SUPPLIER_MONTH, "SELECT security_id, CAST(date AS VARCHAR) AS date, lag(quantity) OVER w AS lag1, lag(quantity, 3) OVER w AS lag3, lag(quantity, 12) OVER w AS lag12 FROM b WINDOW w AS (PARTITION BY security_id ORDER BY date)")
def _(df):
    return df.select("security_id", "date", W.lag_1m("quantity").alias("lag1"), W.lag_3m("quantity").alias("lag3"), W.lag_nm("quantity", 12).alias("lag12"))


@query("day_lags", DAILY, "SELECT security_id, CAST(date AS VARCHAR) AS date, lag(equity_close_raw, 21) OVER w AS lag21, lag(equity_close_raw, 63) OVER w AS lag63 FROM b WINDOW w AS (PARTITION BY security_id ORDER BY date)")
def _(df):
    return df.select("security_id", "date", W.lag_21d("equity_close_raw").alias("lag21"), W.lag_63d("equity_close_raw").alias("lag63"))


_HOLES = SUPPLIER_QUARTER.replace("max(l_extendedprice) AS x", "CASE WHEN (l_suppkey + count(*)) % 6 = 0 THEN NULL ELSE max(l_extendedprice) END AS x")


@query(
    "ttm", _HOLES,
    f"""SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, CASE WHEN row_number() OVER w >= 4 AND count(x) OVER r >= 3 THEN {steady_sql('avg(x) OVER r * 4')} END AS ttm,
      CASE WHEN row_number() OVER w >= 4 AND count(x) OVER r >= 1 THEN {steady_sql('avg(x) OVER r * 4')} END AS ttm_any
    FROM b WINDOW w AS (PARTITION BY security_id ORDER BY rebalance_date), r AS (PARTITION BY security_id ORDER BY rebalance_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(df):
    return df.select("security_id", "rebalance_date", steady(W.ttm("x")).alias("ttm"), steady(W.rolling_sum_4q("x", min_valid=1)).alias("ttm_any"))


@query(
    "year_averages", CUSTOMER_QUARTER,
    """SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, (total_assets + lag(total_assets, 4) OVER w) * 0.5e0 AS assets,
      (book_equity + lag(book_equity, 4) OVER w) * 0.5e0 AS equity, (inventory + lag(inventory, 4) OVER w) * 0.5e0 AS stock FROM b WINDOW w AS (PARTITION BY security_id ORDER BY rebalance_date)""",
)
def _(df):
    return df.select("security_id", "rebalance_date", W.avg_total_assets().alias("assets"), W.avg_book_equity().alias("equity"), W.avg_inventory().alias("stock"))


# Scores and ranks ------------------------------------------------------------------------------------

_CLIPPED = """
, q AS (SELECT rebalance_date AS d, quantile_cont({x}, 0.01) AS lo, quantile_cont({x}, 0.99) AS hi FROM b GROUP BY 1),
c AS (SELECT b.*, CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, lo), hi) END AS y FROM b JOIN q ON rebalance_date = d)
"""
_SCORED = """
SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, CASE WHEN y IS NOT NULL THEN
  (rank() OVER (PARTITION BY rebalance_date ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY rebalance_date, y) - 1) / 2e0) / count(y) OVER (PARTITION BY rebalance_date) - 0.5e0 END AS {out}
FROM c
"""


def _clipped(x: str) -> str:
    return _CLIPPED.replace("{x}", x)


@query("winsorize_xs", CUSTOMER_QUARTER, _clipped("total_assets") + f"SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, {steady_sql('y')} AS clipped FROM c")
def _(df):
    return K.winsorize(df, "total_assets", "rebalance_date", "clipped").select("security_id", "rebalance_date", steady(F.col("clipped")).alias("clipped"))


@query("score_xs", CUSTOMER_QUARTER, _clipped("total_assets") + _SCORED.replace("{out}", "score"))
def _(df):
    return K.score(df, "total_assets").select("security_id", "rebalance_date", "score")


@query("score_low_xs", CUSTOMER_QUARTER, _clipped("(-total_assets)") + _SCORED.replace("{out}", "score_low"))
def _(df):
    return K.score_low(df, "total_assets").select("security_id", "rebalance_date", "score_low")


def _ts_rank_sql(x: str, by: str, order: str, window: int, least: int, keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN {x} IS NOT NULL AND len(h) >= {least} AND len(list_distinct(h)) >= 2 THEN
      (len(list_filter(h, lambda v: v < {x})) + len(list_filter(h, lambda v: v = {x})) * 0.5e0) / len(h) - 0.5e0 END AS ts_rank
    FROM (SELECT *, coalesce(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), []) AS h FROM b) z"""


@query("ts_rank_quarterly", _HOLES, _ts_rank_sql("x", "security_id", "rebalance_date", 20, 12, "security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date"))
def _(df):
    return df.select("security_id", "rebalance_date", K.ts_rank_quarterly("x").alias("ts_rank"))


@query("ts_rank_monthly", SUPPLIER_MONTH, _ts_rank_sql("quantity", "security_id", "date", 60, 36, "security_id, CAST(date AS VARCHAR) AS date"))
def _(df):
    return df.select("security_id", "date", K.ts_rank_monthly("quantity").alias("ts_rank"))


@query("rolling_ts_rank", EVENTS, _ts_rank_sql("value", "user_id", "ts", 15, 5, "event_id"))
def _(df):
    return df.select("event_id", K.rolling_ts_rank("value", 15, 5, "user_id", "ts").alias("ts_rank"))


# Panels -------------------------------------------------------------------------------------------------


@query("monthly_last", SUPPLIER_DAY, "SELECT security_id, CAST(date AS VARCHAR) AS date, price, n FROM b QUALIFY row_number() OVER (PARTITION BY security_id, date_trunc('month', date) ORDER BY date DESC) = 1")
def _(df):
    return panels.monthly_last(df).select("security_id", "date", "price", "n")


@query("dedup_keep_last", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM {orders}", "SELECT o_orderkey, o_custkey, CAST(d AS VARCHAR) AS d, o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey, d ORDER BY o_orderkey DESC) = 1")
def _(df):
    return asof.keep_last(df, ["o_custkey", "d"], F.col("o_orderkey").desc())


@query(
    "rebalance_grid", SUPPLIER_DAY,
    """, s AS (SELECT security_id, min(date) AS lo, max(date) AS hi FROM b GROUP BY 1), e AS (SELECT CAST(last_day(d) AS DATE) AS rebalance_date FROM (SELECT unnest(generate_series(DATE '1990-03-01', DATE '2010-12-01', INTERVAL 3 MONTH)) AS d) x)
    SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, CAST(CAST(last_day(rebalance_date - INTERVAL 3 MONTH) AS DATE) AS VARCHAR) AS prev_q FROM s JOIN e ON rebalance_date BETWEEN lo AND hi""",
)
def _(df):
    return panels.rebalance_grid(df)


_SIDES = """
SELECT l_returnflag AS side, l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM {lineitem} WHERE l_returnflag IN ('A', 'R')
"""
_ASOF = """
, l AS (SELECT security_id, day, l_orderkey, l_linenumber, l_partkey FROM b WHERE side = 'A'),
r AS (SELECT security_id, day AS told, l_extendedprice AS price, l_quantity AS quantity FROM b WHERE side = 'R' QUALIFY row_number() OVER (PARTITION BY security_id, day ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
j AS (SELECT l.*, told, price, quantity FROM l ASOF LEFT JOIN r ON l.security_id = r.security_id AND l.day >= r.told)
"""


def _asof(df):
    left = df.where("side = 'A'").select("security_id", "day", "l_orderkey", "l_linenumber", "l_partkey")
    right = asof.keep_last(df.where("side = 'R'"), ["security_id", "day"], *[F.col(c).desc() for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    right = right.select("security_id", F.col("day").alias("told"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return asof.asof_join(left, right, ["security_id"], "day", "told")


_ASOF_KEYS = "security_id, CAST(day AS VARCHAR) AS day, l_orderkey, l_linenumber, l_partkey"


@query("asof_backward", _SIDES, _ASOF + f"SELECT {_ASOF_KEYS}, CAST(told AS VARCHAR) AS told, price, quantity FROM j")
def _(df):
    return _asof(df)


@query("asof_stale_guard", _SIDES, _ASOF + f"SELECT {_ASOF_KEYS}, CASE WHEN ok THEN CAST(told AS VARCHAR) END AS told, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN quantity END AS quantity FROM (SELECT *, coalesce(told >= day - 5, true) AS ok FROM j) x")
def _(df):
    return asof.null_where(_asof(df), F.col("told") < F.date_sub("day", 5), ["told", "price", "quantity"])


@query(
    "asof_composite_key", _SIDES,
    """, l AS (SELECT security_id, l_linenumber, day, l_orderkey, l_partkey FROM b WHERE side = 'A'),
    r AS (SELECT security_id, l_linenumber, day AS told, l_extendedprice AS price FROM b WHERE side = 'R' QUALIFY row_number() OVER (PARTITION BY security_id, l_linenumber, day ORDER BY l_orderkey DESC, l_partkey DESC) = 1)
    SELECT l.security_id, l.l_linenumber, CAST(day AS VARCHAR) AS day, l_orderkey, l_partkey, CAST(told AS VARCHAR) AS told, price
    FROM l ASOF LEFT JOIN r ON l.security_id = r.security_id AND l.l_linenumber = r.l_linenumber AND l.day >= r.told""",
)
def _(df):
    keys = ["security_id", "l_linenumber"]
    right = asof.keep_last(df.where("side = 'R'"), [*keys, "day"], F.col("l_orderkey").desc(), F.col("l_partkey").desc())
    right = right.select(*keys, F.col("day").alias("told"), F.col("l_extendedprice").alias("price"))
    return asof.asof_join(df.where("side = 'A'").select(*keys, "day", "l_orderkey", "l_partkey"), right, keys, "day", "told")


#: A quarterly source: a row for each supplier and quarter with announcements, actuals, consensus.
_FUND = """
SELECT l_suppkey AS security_id, date, CASE WHEN n % 7 = 1 THEN NULL ELSE CAST(date + INTERVAL '40' DAY AS DATE) END AS announce_date, concat('S', CAST(l_suppkey AS VARCHAR(12))) AS ticker,
  CASE WHEN n % 5 = 1 THEN NULL ELSE hi END AS total_assets, date AS actuals_period_end, CASE WHEN n % 4 = 1 THEN NULL ELSE CAST(date + INTERVAL '30' DAY AS DATE) END AS actuals_announce_date,
  CASE WHEN n % 6 = 1 THEN NULL ELSE lo END AS actuals_actual_eps, CASE WHEN n % 3 = 1 THEN NULL ELSE date END AS consensus_forecast_period_end,
  CAST(date + CASE WHEN n % 2 = 0 THEN INTERVAL '20' DAY ELSE INTERVAL '35' DAY END AS DATE) AS consensus_statistic_date, q AS consensus_eps_mean
FROM (SELECT l_suppkey, CAST(date_trunc('quarter', CAST(l_shipdate AS TIMESTAMP)) AS DATE) AS date, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, max(l_quantity) AS q, count(*) AS n FROM {lineitem} GROUP BY 1, 2) x
"""
_REBALANCE = """
, s AS (SELECT security_id, min(date) AS lo, max(date) AS hi FROM b GROUP BY 1),
e AS (SELECT CAST(last_day(d) AS DATE) AS rebalance_date, CAST(last_day(d - INTERVAL 3 MONTH) AS DATE) AS prev_q FROM (SELECT CAST(unnest(generate_series(DATE '1990-03-01', DATE '2010-12-01', INTERVAL 3 MONTH)) AS DATE) AS d) x),
g AS (SELECT security_id, rebalance_date, prev_q FROM s JOIN e ON rebalance_date BETWEEN lo AND hi),
f AS (SELECT security_id, announce_date, ticker, total_assets FROM b WHERE announce_date IS NOT NULL),
a AS (SELECT security_id, actuals_period_end, actuals_announce_date, actuals_actual_eps FROM b WHERE actuals_announce_date IS NOT NULL),
c AS (SELECT security_id, consensus_forecast_period_end, consensus_statistic_date, consensus_eps_mean FROM b WHERE consensus_forecast_period_end IS NOT NULL),
gf AS (SELECT g.*, announce_date, ticker, total_assets, coalesce(announce_date < prev_q, false) AS stale FROM g ASOF LEFT JOIN f ON g.security_id = f.security_id AND g.rebalance_date >= f.announce_date),
ga0 AS (SELECT gf.*, a.actuals_period_end AS p, a.actuals_announce_date AS t, a.actuals_actual_eps AS v FROM gf ASOF LEFT JOIN a ON gf.security_id = a.security_id AND gf.rebalance_date >= a.actuals_announce_date),
ga AS (SELECT *, CASE WHEN t >= prev_q THEN p END AS actuals_period_end, CASE WHEN t >= prev_q THEN t END AS actuals_announce_date, CASE WHEN t >= prev_q THEN v END AS actuals_actual_eps FROM ga0),
gc AS (SELECT ga.*, consensus_forecast_period_end, consensus_statistic_date, consensus_eps_mean FROM ga ASOF LEFT JOIN c ON ga.security_id = c.security_id AND ga.actuals_period_end = c.consensus_forecast_period_end AND ga.actuals_announce_date >= c.consensus_statistic_date)
SELECT security_id, CAST(rebalance_date AS VARCHAR) AS rebalance_date, CASE WHEN NOT stale THEN CAST(announce_date AS VARCHAR) END AS announce_date, ticker, CASE WHEN NOT stale THEN total_assets END AS total_assets,
  CAST(actuals_period_end AS VARCHAR) AS actuals_period_end, CAST(actuals_announce_date AS VARCHAR) AS actuals_announce_date, actuals_actual_eps,
  CASE WHEN actuals_actual_eps IS NOT NULL THEN CAST(consensus_forecast_period_end AS VARCHAR) END AS consensus_forecast_period_end,
  CASE WHEN actuals_actual_eps IS NOT NULL THEN CAST(consensus_statistic_date AS VARCHAR) END AS consensus_statistic_date, CASE WHEN actuals_actual_eps IS NOT NULL THEN consensus_eps_mean END AS consensus_eps_mean
FROM gc
"""


@query("rebalance_panel", _FUND, _REBALANCE)
def _(df):
    return panels.rebalance_panel(df)


#: Whole numbers of every unit, on both sides of the epoch and at the last nanosecond of a day; the
#: day is o_orderkey's, up to 20,000 days from 1970 so that nanoseconds fit.
_DAYS = """
SELECT o_orderkey, o_orderdate AS rebalance_date, concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T23:30:00-05:00') AS told, d * 86400000 + 5 AS millis, abs(d) * 86400000000000 + 1000000000000000000 AS nanos,
  d * 86400000000000 + 86399999999999 AS last_nanos, d * 86400000000 + 86399999999 AS micros, d * 86400 AS seconds, d % 9 * 86400000000000 + 1 AS early_nanos
FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 20000) AS d FROM {orders}) x
"""
_UNITS = {"millis": "ms", "last_nanos": "ns", "micros": "us", "seconds": "s", "early_nanos": "ns"}


@query(
    "standardise_dates", _DAYS,
    """, x AS (SELECT *, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 20000) AS INTEGER) AS d FROM b)
    SELECT o_orderkey, CAST(CAST(rebalance_date AS DATE) AS VARCHAR) AS date, CAST(CAST(rebalance_date AS DATE) + 1 AS VARCHAR) AS told, CAST(DATE '2001-09-09' + abs(d) AS VARCHAR) AS nanos,
      CAST(DATE '1970-01-01' + d AS VARCHAR) AS millis, CAST(DATE '1970-01-01' + d AS VARCHAR) AS last_nanos, CAST(DATE '1970-01-01' + d AS VARCHAR) AS micros, CAST(DATE '1970-01-01' + d AS VARCHAR) AS seconds, CAST(DATE '1970-01-01' + d % 9 AS VARCHAR) AS early_nanos FROM x""",
)
def _(df):
    return panels.standardise_dates(df, ["date", "told", "nanos", *_UNITS], {"rebalance_date": "date"}, _UNITS)


# Targets --------------------------------------------------------------------------------------------------


def _state_sql(r: str) -> str:
    return f"""
, cal AS (SELECT date AS d, lag(date) OVER (ORDER BY date) AS prev_market FROM (SELECT DISTINCT date FROM b) z),
v AS (SELECT security_id, ticker, date, {r} AS r, coalesce(lag(date) OVER (PARTITION BY security_id ORDER BY date) = prev_market AND {r} > -1, false) AS ok FROM b JOIN cal ON date = d),
st AS (SELECT security_id, ticker, date, sum(CASE WHEN ok THEN ln(1 + r) ELSE 0 END) OVER w AS cum_log_return, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS BIGINT) AS cum_invalid FROM v
  WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
me AS (SELECT st.*, CAST(year(date) * 12 + month(date) AS INTEGER) AS month FROM st JOIN (SELECT max(date) AS e FROM b GROUP BY date_trunc('month', date)) x ON date = e)
"""


def _target_sql(h: int, quarters: bool) -> str:
    return f"""
, t AS (SELECT a.security_id, a.ticker, CAST(a.date AS VARCHAR) AS date, CAST(z.date AS VARCHAR) AS target_{h}m_end_date,
  CASE WHEN z.cum_invalid = a.cum_invalid THEN exp(z.cum_log_return - a.cum_log_return) - 1 END AS target_{h}m
  FROM me a LEFT JOIN me z ON a.security_id = z.security_id AND z.month = a.month + {h} {"WHERE month(a.date) IN (3, 6, 9, 12)" if quarters else ""})
"""


def _rounded_target_sql(h: int) -> str:
    return f"SELECT security_id, ticker, date, target_{h}m_end_date, {steady_sql(f'target_{h}m')} AS target_{h}m FROM t"


_TOTAL = "equity_total_return"


@query("return_state", DAILY, _state_sql(_TOTAL) + f"SELECT security_id, ticker, CAST(date AS VARCHAR) AS date, {steady_sql('cum_log_return')} AS cum_log_return, cum_invalid FROM st")
def _(df):
    return targets.return_state(df).withColumn("cum_log_return", steady(F.col("cum_log_return"))).drop("market_month_end")


@query("market_month_end", DAILY, _state_sql(_TOTAL) + "SELECT security_id, CAST(date AS VARCHAR) AS date, month, cum_invalid FROM me")
def _(df):
    return targets.market_month_end(targets.return_state(df)).select("security_id", "date", "month", "cum_invalid")


def _targets(df, h, quarters=False, unit="fraction"):
    return targets.horizon_targets(targets.market_month_end(targets.return_state(df, unit)), h, quarters)


def _rounded(df, h):
    return df.withColumn(f"target_{h}m", steady(F.col(f"target_{h}m")))


@query("target_1m", DAILY, _state_sql(_TOTAL) + _target_sql(1, False) + _rounded_target_sql(1))
def _(df):
    return _rounded(_targets(df, 1), 1)


@query("target_3m", DAILY, _state_sql(_TOTAL) + _target_sql(3, True) + _rounded_target_sql(3))
def _(df):
    return _rounded(_targets(df, 3, True), 3)


@query("target_percent_unit", DAILY, _state_sql(f"({_TOTAL} / 100e0)") + _target_sql(1, False) + _rounded_target_sql(1))
def _(df):
    return _rounded(_targets(df, 1, unit="percent"), 1)


@query(
    "target_report", DAILY,
    _state_sql(_TOTAL) + _target_sql(1, False) + f"""SELECT count(*) AS n_rows, count(target_1m) AS n_valid, count(*) FILTER (target_1m_end_date IS NULL) AS n_no_endpoint,
      count(*) FILTER (target_1m_end_date IS NOT NULL AND target_1m IS NULL) AS n_broken, {steady_sql('avg(target_1m)')} AS mean, {steady_sql('quantile_cont(target_1m, 0.5)')} AS median,
      {steady_sql('quantile_cont(target_1m, 0.01)')} AS p01, {steady_sql('quantile_cont(target_1m, 0.99)')} AS p99, {steady_sql('min(target_1m)')} AS min, {steady_sql('max(target_1m)')} AS max FROM t""",
)
def _(df):
    out = targets.target_report(_targets(df, 1), 1)
    return out.withColumns({c: steady(F.col(c)) for c in ("mean", "median", "p01", "p99", "min", "max")})


# Files, builders, and what is missing -----------------------------------------------------------------------

#: DAILY with NaN, infinities, rows of no entity, and numbers that are none.
_NAN, _INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
DIRTY = f"""
SELECT CASE WHEN n % 17 = 0 THEN NULL ELSE security_id END AS security_id, ticker, date, equity_open_raw,
  CASE WHEN n % 10 = 1 THEN {_NAN} WHEN n % 10 = 2 THEN {_INF} ELSE equity_high_raw END AS equity_high_raw, equity_low_raw, CASE WHEN n % 19 = 3 THEN {_NAN} ELSE equity_close_raw END AS equity_close_raw, equity_price_adj_factor,
  CASE WHEN n % 12 = 1 THEN {_NAN} WHEN n % 12 = 2 THEN -{_INF} ELSE equity_adj_close END AS equity_adj_close,
  CASE WHEN n % 23 = 1 THEN {_NAN} WHEN n % 23 = 2 THEN {_INF} WHEN n % 23 = 3 THEN -1e0 ELSE equity_total_return END AS equity_total_return,
  CASE WHEN n % 14 = 1 THEN {_NAN} WHEN n % 14 = 2 THEN {_INF} ELSE equity_price_return_ex_div END AS equity_price_return_ex_div, n AS equity_volume_raw, equity_close_flag
FROM (SELECT *, equity_volume_raw AS n FROM ({DAILY}) z) w
"""


def _fin(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def _value(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def scratch(spark: SparkSession) -> str:
    """A folder for the files of a builder's query: in the shared folder that the session names, else in
    its warehouse. It goes when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/panels-{uuid.uuid4().hex}"
    fs, place = io._place(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def _written(df: DataFrame) -> str:
    path = f"{scratch(df.sparkSession)}/source.parquet"
    io.write_panel(df, path)
    return path


_FLOATS = ["equity_high_raw", "equity_adj_close", "equity_total_return", "equity_price_return_ex_div"]


@query("read_panel", DIRTY, "SELECT security_id, CAST(date AS VARCHAR) AS date, equity_volume_raw, " + ", ".join(f"{_value(c)} AS {c}" for c in _FLOATS) + " FROM b")
def _(df):
    """What was NaN in a file is missing, infinities stay; only the named columns are read."""
    return io.read_panel(df.sparkSession, _written(df), ["security_id", "date", "equity_volume_raw", *_FLOATS])


_DIRTY_MASKS = f"""
, f AS (SELECT *, {_fin('equity_open_raw')} AS o, {_fin('equity_high_raw')} AS h, {_fin('equity_low_raw')} AS l, {_fin('equity_close_raw')} AS c, {_fin('equity_adj_close')} AS a, {_fin('equity_price_return_ex_div')} AS r FROM b),
cal AS (SELECT date AS d, lag(date) OVER (ORDER BY date) AS prev_market FROM (SELECT DISTINCT date FROM b) z),
w AS (SELECT f.*, prev_market, lag(date) OVER s AS prev_date, lag(a) OVER s AS prev_a FROM f JOIN cal ON date = d WINDOW s AS (PARTITION BY security_id ORDER BY date)),
m AS (SELECT *, coalesce(o + h + l + c IS NOT NULL AND (h < l OR o > h OR o < l OR c > h OR c < l), false) AS r1, coalesce(c > 0 AND abs(a * equity_price_adj_factor - c) > 1e-2 + 5e-3 * abs(c), false) AS r3,
  coalesce(security_id IS NOT NULL AND prev_date = prev_market AND a > 0 AND prev_a > 0 AND abs(r - (a / prev_a - 1e0)) > 5e-4, false) AS r2 FROM w)
"""


@query(
    "build_daily", DIRTY,
    _DIRTY_MASKS + f"SELECT security_id, CAST(date AS VARCHAR) AS date, equity_low_raw, {_value('equity_close_raw')} AS equity_close_raw, {_value('equity_high_raw')} AS equity_high_raw, CASE WHEN NOT r2 THEN {_value('equity_price_return_ex_div')} END AS equity_price_return_ex_div, equity_close_flag FROM m WHERE NOT (r1 OR r3)",
)
def _(df):
    """Extraction, cleaning and files of the daily panel from a wide one."""
    spark, source = df.sparkSession, _written(df)
    out = scratch(spark)
    build.build_daily(spark, source, out)
    return io.read_panel(spark, f"{out}/daily_clean.parquet", ["security_id", "date", "equity_low_raw", "equity_close_raw", "equity_high_raw", "equity_price_return_ex_div", "equity_close_flag"])


@query(
    "build_daily_report", DIRTY,
    _DIRTY_MASKS + """SELECT count(*) AS input_rows, CAST(13 AS BIGINT) AS input_columns, count(*) FILTER (r1) AS r1_rows, count(*) FILTER (r2) AS r2_rows, count(*) FILTER (r3) AS r3_rows, count(*) FILTER (r1 AND r3) AS r1_and_r3,
      count(*) FILTER (r1 OR r3) AS deleted_rows, count(*) FILTER (r2 AND (r1 OR r3)) AS r2_deleted, count(*) FILTER (r2 AND NOT (r1 OR r3)) AS r2_emptied, CAST(0 AS BIGINT) AS r1_left, CAST(0 AS BIGINT) AS r3_left FROM m""",
)
def _(df):
    return build.build_daily(df.sparkSession, _written(df), scratch(df.sparkSession))


_MONTHLY = {
    "security_id": "l_suppkey", "ticker": "concat('S', CAST(l_suppkey AS VARCHAR(12)))", "date": "CAST(l_shipdate AS TIMESTAMP)", "rec_mean": "max(l_extendedprice)", "rec_count": "count(*)",
    "tp_statistic_date": "CAST(l_shipdate AS TIMESTAMP)", "rec_unanimous_coverage_flag": "count(*) > 1", "macro_cpi_index": "CASE WHEN l_suppkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE min(l_tax) END",
}
MONTHLY = "SELECT " + ", ".join(f"{_MONTHLY.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in schema.MONTHLY_COLUMNS) + ", max(l_quantity) AS other FROM {lineitem} GROUP BY l_suppkey, l_shipdate"


@query(
    "build_monthly", MONTHLY,
    f"""SELECT {', '.join(f'CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}' if c in schema.MONTHLY_DATES else f'{_value(c)} AS {c}' if c == 'macro_cpi_index' else c for c in schema.MONTHLY_COLUMNS)}
    FROM b QUALIFY row_number() OVER (PARTITION BY security_id, date_trunc('month', date) ORDER BY date DESC) = 1""",
)
def _(df):
    """The monthly panel's file from a wide one."""
    spark, source = df.sparkSession, _written(df)
    out = f"{scratch(spark)}/monthly.parquet"
    build.build_monthly(spark, source, out)
    return spark.read.parquet(out)


_FUND_COLUMNS = ["security_id", "date", "announce_date", "ticker", "total_assets", *schema.QUARTERLY_ACTUALS[:3], "consensus_forecast_period_end", "consensus_statistic_date", "consensus_eps_mean"]
_QUARTERLY = {"total_assets_dnu_flag": "actuals_actual_eps IS NULL", "consensus_odd_flag": "true", "total_assets_imputed_flag": "true", "ocf_dnu_flag": "false", "capex_dnu_flag": "false"}
QUARTERLY = "SELECT " + ", ".join([*_FUND_COLUMNS, *[f"{_QUARTERLY.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in dict.fromkeys([*schema.quarterly_columns([]), *_QUARTERLY]) if c not in _FUND_COLUMNS]]) + f" FROM ({_FUND}) y"


@query(
    "build_quarterly", QUARTERLY,
    _REBALANCE.replace("f AS (SELECT security_id, announce_date, ticker, total_assets FROM b", "f AS (SELECT security_id, announce_date, ticker, CASE WHEN actuals_actual_eps IS NOT NULL THEN total_assets END AS total_assets FROM b"),
)
def _(df):
    """Column selection, rebalance panel and do-not-use flags from a quarterly source's file."""
    spark, source = df.sparkSession, _written(df)
    out = f"{scratch(spark)}/quarterly.parquet"
    build.build_quarterly(spark, source, out)
    return spark.read.parquet(out).select("security_id", "rebalance_date", "announce_date", "ticker", "total_assets", *schema.QUARTERLY_ACTUALS[:3], "consensus_forecast_period_end", "consensus_statistic_date", "consensus_eps_mean")


_SOURCE = ["date", "zzz", "revenue_dnu_flag", "consensus_late_flag", "inventory_imputed_flag", "actuals_eps_outlier_flag", "net_ppe_flag", "actuals_odd_flag", "unknown_flag", "eps_basic", "cogs_flag_note", "capex_ytd_dnu_flag"]
_FLAGS_FOUND = ["capex_dnu_flag", "capex_structural_missing_flag", "capex_ytd_dnu_flag", "net_ppe_flag", "ocf_dnu_flag", "ocf_structural_missing_flag", "revenue_dnu_flag", "consensus_late_flag", "actuals_odd_flag"]
_CHOSEN = [*schema.QUARTERLY_KEYS_META, *schema.QUARTERLY_ACCOUNTS, *schema.QUARTERLY_CONSENSUS, *schema.QUARTERLY_CONSENSUS_MORE, *schema.QUARTERLY_ACTUALS, *schema.QUARTERLY_QC, *_FLAGS_FOUND]


@query("quarterly_columns", "SELECT 1 AS one", f"SELECT CAST(generate_subscripts(c, 1) AS INTEGER) AS place, unnest(c) AS name FROM (SELECT {_CHOSEN!r} AS c) x")
def _(df):
    return df.sparkSession.createDataFrame(list(enumerate(schema.quarterly_columns(_SOURCE), 1)), "place int, name string")


@query("quarterly_report", "SELECT 1 AS one", f"SELECT 12 AS n_source, {len(_CHOSEN)} AS n_selected, {len(_CHOSEN) - 7} AS n_missing, 1 AS n_keys, 1 AS n_accounts, 5 AS n_flags")
def _(df):
    r = schema.quarterly_report(_SOURCE)
    return df.sparkSession.createDataFrame([(r["source"], r["selected"], len(r["missing"]), r["groups"]["keys"], r["groups"]["accounts"], r["groups"]["flags"])], "n_source int, n_selected int, n_missing int, n_keys int, n_accounts int, n_flags int")


@query(
    "validate_keys", "SELECT l_orderkey AS security_id, l_linenumber, CAST(l_shipdate AS DATE) AS date, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) AS text FROM {lineitem}",
    """SELECT 'absent' AS input, 'missing columns: [''nowhere'']' AS said
    UNION ALL SELECT 'dates', concat(format('{:,}', count(*)), ' invalid or missing dates') FROM b WHERE l_linenumber > 2
    UNION ALL SELECT 'repeated', concat(format('{:,}', CAST(sum(n - 1) AS BIGINT)), ' duplicate (security_id, date) rows') FROM (SELECT CASE WHEN security_id % 3 > 0 THEN security_id END AS s, date, count(*) AS n FROM b GROUP BY 1, 2) x
    UNION ALL SELECT 'sound', 'nothing'""",
)
def _(df):
    """What validation says of absent columns, dates that are none, repeated keys (those of no entity
    are equal), and a sound panel."""
    frames = {
        "absent": (df, ["security_id", "nowhere"]),
        "dates": (df.withColumn("date", F.when(F.col("l_linenumber") == 1, F.col("text")).when(F.col("l_linenumber") > 2, F.lit("no date")).otherwise(F.col("text"))), ["date"]),
        "repeated": (df.withColumn("security_id", F.when(F.col("security_id") % 3 > 0, F.col("security_id"))), ["date"]),
        "sound": (df.dropDuplicates(["security_id", "date"]), ["date"]),
    }
    said = []
    for name, (frame, required) in frames.items():
        try:
            quality.validate_keys(frame, required)
            said.append((name, "nothing"))
        except ValueError as error:
            said.append((name, str(error)))
    return df.sparkSession.createDataFrame(said, "input string, said string")


#: DAILY whose returns are in part NaN, infinite or a total loss.
_RETURNS = DAILY.replace("ELSE (max(l_discount)", f"WHEN count(*) % 41 = 1 THEN {_NAN} WHEN count(*) % 43 = 1 THEN {_INF} WHEN count(*) % 47 = 1 THEN -1e0 ELSE (max(l_discount)")
_BUILT_STATE = _state_sql(_fin(_TOTAL))


def _built_targets_sql(h: int, quarters: bool) -> str:
    return _BUILT_STATE + _target_sql(h, quarters) + _rounded_target_sql(h)


def _built(df, name):
    spark, source = df.sparkSession, _written(df)
    out = scratch(spark)
    build.build_targets(spark, source, out)
    return spark.read.parquet(f"{out}/{name}.parquet")


@query("build_targets_monthly", _RETURNS, _built_targets_sql(1, False))
def _(df):
    """Validation, return state and the file of one-month targets from a daily panel's file."""
    return _rounded(_built(df, "monthly_targets"), 1)


@query("build_targets_quarterly", _RETURNS, _built_targets_sql(3, True))
def _(df):
    return _rounded(_built(df, "quarterly_targets"), 3)


@query(
    "standardise_in_place", _DAYS,
    "SELECT o_orderkey, CAST(CAST(rebalance_date AS DATE) AS VARCHAR) AS date, CAST(DATE '1970-01-01' + CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 20000) AS INTEGER) AS VARCHAR) AS micros FROM b",
)
def _(df):
    """A panel's file rewritten where it is, twice, which changes nothing more."""
    spark, path = df.sparkSession, _written(df.select("o_orderkey", "rebalance_date", "micros"))
    for _ in range(2):
        build.standardise(spark, path, ["date", "micros"], {"rebalance_date": "date"}, {"micros": "us"})
    return spark.read.parquet(path)


_TIED = f"SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS user_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 13 = 1 THEN {_NAN} WHEN event_id % 13 = 2 THEN {_INF} WHEN event_id % 13 = 3 THEN NULL ELSE floor(value) END AS value FROM {{events}}"


@query(
    "ties_and_missing", _TIED,
    f""", v AS (SELECT *, {_value('value')} AS x, {_fin('value')} AS y FROM b)
    SELECT event_id, CASE WHEN user_id IS NOT NULL THEN CASE WHEN isinf(lag(x) OVER w) THEN -1e0 ELSE lag(x) OVER w END END AS lag1, CASE WHEN user_id IS NOT NULL AND row_number() OVER w >= 4 AND count(y) OVER r >= 2 THEN {steady_sql('avg(y) OVER r * 4')} END AS ttm,
      CASE WHEN user_id IS NOT NULL AND y IS NOT NULL AND len(h) >= 3 AND len(list_distinct(h)) >= 2 THEN (len(list_filter(h, lambda q: q < y)) + len(list_filter(h, lambda q: q = y)) * 0.5e0) / len(h) - 0.5e0 END AS ts_rank
    FROM (SELECT *, coalesce(list(y) FILTER (y IS NOT NULL) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM v) z
    WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id), r AS (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def _(df):
    """Rows of one day in the order of a further column; NaN, infinities and rows of no entity."""
    df, ties = X.nan_to_null(df), ["event_id"]
    lag = W.group_shift("value", 1, "user_id", "day", ties)
    return df.select("event_id", F.when(F.abs(lag) == X.INFINITY, F.lit(-1.0)).otherwise(lag).alias("lag1"), steady(W.rolling_sum_4q("value", "user_id", "day", 2, ties)).alias("ttm"), K.rolling_ts_rank("value", 8, 3, "user_id", "day", ties).alias("ts_rank"))


# The flagship -------------------------------------------------------------------------------------------------


@query(
    "flagship", SUPPLIER_DAY,
    """, m AS (SELECT security_id, date, date_trunc('month', date) AS mo, price, n FROM b QUALIFY row_number() OVER (PARTITION BY security_id, date_trunc('month', date) ORDER BY date DESC) = 1),
    g AS (SELECT *, price / lag(price) OVER (PARTITION BY security_id ORDER BY date) AS growth FROM m),
    q AS (SELECT mo AS d, quantile_cont(growth, 0.01) AS lo, quantile_cont(growth, 0.99) AS hi FROM g GROUP BY 1),
    c AS (SELECT g.*, CASE WHEN growth IS NOT NULL THEN least(greatest(growth, lo), hi) END AS y FROM g JOIN q ON mo = d)
    SELECT security_id, CAST(date AS VARCHAR) AS date, growth, CASE WHEN y IS NOT NULL THEN (rank() OVER (PARTITION BY mo ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY mo, y) - 1) / 2e0) / count(y) OVER (PARTITION BY mo) - 0.5e0 END AS score FROM c""",
)
def _(df):
    """Each supplier's last price of a month over the one before, scored across suppliers."""
    last = panels.monthly_last(df).withColumn("month", X.month_index("date"))
    grown = last.withColumn("growth", X.safe_divide("price", W.lag_1m("price")))
    return K.score(grown, "growth", "month").select("security_id", "date", "growth", "score")


flagship = QUERIES["flagship"]
