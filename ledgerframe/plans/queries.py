"""Registered queries: each runs an operator over the whole tables, beside equivalent SQL.

Doubles are rounded to 8 places on both sides. The SQL shares its building blocks as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.draws import quantile_ranks, resampled_ranks_sql, with_uniform_sql
from ..operators import attribution as A, backtest as B, covariance as C, models as D, rebalance as M, regime as G, returns as R, stats as P, var as V
from ..sources import loaders as L, tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

W = 252
ALPHA = 0.05
BOOKS = [("core", "ECONOMY", 0.4), ("core", "MEDIUM", 0.35), ("core", "LARGE", 0.25), ("hedged", "PROMO", 0.8), ("hedged", "SMALL", -0.5), ("wide", "ECONOMY", 0.2), ("wide", "LARGE", 0.2), ("wide", "MEDIUM", 0.1), ("wide", "PROMO", 0.2), ("wide", "SMALL", 0.1), ("wide", "STANDARD", 0.2)]
MODELS = [("GROWTH", "ECONOMY", 0.25), ("GROWTH", "LARGE", 0.2), ("GROWTH", "MEDIUM", 0.15), ("GROWTH", "PROMO", 0.15), ("GROWTH", "SMALL", 0.15), ("GROWTH", "STANDARD", 0.1), ("INCOME", "ECONOMY", 0.1), ("INCOME", "LARGE", 0.15), ("INCOME", "MEDIUM", 0.2), ("INCOME", "PROMO", 0.15), ("INCOME", "SMALL", 0.15), ("INCOME", "STANDARD", 0.25)]
SLEEVES = [("ECONOMY", "equity"), ("LARGE", "equity"), ("PROMO", "abroad"), ("SMALL", "abroad"), ("MEDIUM", "bonds"), ("STANDARD", "bonds")]
LEGS = [("ECONOMY", "LONG", 0.7), ("LARGE", "LONG", 0.3), ("SMALL", "SHORT", 0.5), ("PROMO", "SHORT", 0.5)]
BETAS = [("ECONOMY", "mkt", 1.1), ("ECONOMY", "mom", 0.2), ("LARGE", "mkt", 0.9), ("LARGE", "mom", -0.1), ("SMALL", "mkt", 1.3), ("SMALL", "mom", 0.5)]
TRIANGLE = [("mkt", "mkt", 0.04), ("mkt", "mom", 0.01), ("mom", "mom", 0.02)]
RESID = [("ECONOMY", 0.01), ("LARGE", 0.02), ("SMALL", 0.03)]


def values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in rows) + f") AS t({names})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def books(spark):
    return literal(spark, BOOKS, "book string, ticker string, weight double")


def models(spark):
    return literal(spark, MODELS, "model_id string, ticker string, weight double")


def book_ret(spark, sf):
    return R.book_returns(T.price_panel(spark, sf), books(spark))


def last_prices(spark, sf):
    return L.keep_last(T.price_panel(spark, sf), ["ticker"], ["date"]).select("ticker", "price")


def one_model(spark, name):
    return models(spark).where(F.col("model_id") == name)


def r8(expr: str, name: str) -> str:
    return f"round({expr}, 8) AS {name}"


PANEL = """base AS (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, COUNT(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
rolled AS (SELECT ticker, date, SUM(c) OVER w AS s, SUM(n) OVER w AS m, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM base
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
panel AS (SELECT ticker, date, CAST(s AS DOUBLE) / (CAST(m AS DOUBLE) * 100000.0) AS price FROM rolled WHERE rn >= 60)"""
GRID = PANEL + """,
grid AS (SELECT t.ticker, d.date, p.price FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) d LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = d.date),
padded AS (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM grid),
raw AS (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM padded),
ret AS (SELECT ticker, date, r FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k, count(*) OVER (PARTITION BY date) AS n FROM raw) WHERE k = n)"""
BOOKRET = PANEL + f""",
books AS (SELECT * FROM {values(BOOKS, 'book, ticker, weight')}),
own AS (SELECT b.book, p.ticker, p.date, p.price FROM panel p JOIN books b USING (ticker)),
grid AS (SELECT t.book, t.ticker, d.date, p.price FROM (SELECT DISTINCT book, ticker FROM own) t JOIN (SELECT DISTINCT book, date FROM own) d USING (book) LEFT JOIN own p ON p.book = t.book AND p.ticker = t.ticker AND p.date = d.date),
padded AS (SELECT book, ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY book, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM grid),
raw AS (SELECT book, ticker, date, price / lag(price) OVER (PARTITION BY book, ticker ORDER BY date) - 1 AS r FROM padded),
whole AS (SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY book, date) AS k, count(*) OVER (PARTITION BY book, date) AS n FROM raw) WHERE k = n),
bret AS (SELECT w.book, w.date, SUM(b.weight * w.r) AS r FROM whole w JOIN books b USING (book, ticker) GROUP BY 1, 2)"""
RUNNING = BOOKRET + """,
wealth AS (SELECT *, product(1 + r) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM bret),
curve AS (SELECT book, date, r, w - 1 AS cumulative, w / greatest(max(w) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1 AS drawdown FROM wealth)"""

# --- scans, panels, returns ---------------------------------------------------------------------------------------


@query("price_panel", f"WITH {PANEL} SELECT ticker, date, {r8('price', 'price')} FROM panel")
def _(spark, sf):
    return T.price_panel(spark, sf)


@query("dedup_keep_last", """SELECT l_orderkey AS ticker, l_linenumber AS line, round(l_extendedprice, 8) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS nr FROM lineitem) WHERE nr = 1""")
def _(spark, sf):
    rows = T.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    kept = L.keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return kept.select(F.col("l_orderkey").alias("ticker"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))


@query("prices_on_trading_days", f"WITH {PANEL} SELECT ticker, date, {r8('price', 'price')} FROM panel WHERE isodow(date) <= 5")
def _(spark, sf):
    p = T.price_panel(spark, sf)
    source = p.select("ticker", F.col("date").cast("timestamp").alias("price_date"), F.col("price").alias("adj_close_price"), F.col("price").alias("close_price"), F.lit("etf").alias("instrument_type"))
    calendar = p.select(F.col("date").alias("cal_date")).distinct().withColumn("is_trading_day", (F.weekday("cal_date") < 5).cast("int"))
    return L.get_prices(source, calendar, list(TICKERS), "1900-01-01", "2100-12-31")


TICKERS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("wide_pivot", f"WITH {PANEL}, twice AS (SELECT ticker, date, price * 2 AS price, 0 AS loaded FROM panel UNION ALL SELECT ticker, date, price, 1 FROM panel UNION ALL SELECT ticker, date, -price, -1 FROM panel) SELECT date, " + ", ".join(r8(f"arg_max(price, loaded) FILTER (WHERE ticker = '{t}')", t) for t in TICKERS) + " FROM twice GROUP BY date")
def _(spark, sf):
    p = T.price_panel(spark, sf).withColumn("version", F.explode(F.array(*[F.struct(F.lit(k).alias("loaded"), F.lit(by).alias("by")) for k, by in ((0, 2.0), (1, 1.0), (-1, -1.0))])))
    return L.to_wide(p.select("ticker", "date", (F.col("price") * F.col("version.by")).alias("price"), F.col("version.loaded").alias("loaded")), TICKERS, order=["loaded"])


@query("returns_simple_pad", f"WITH {GRID} SELECT ticker, date, {r8('r', 'r')} FROM ret")
def _(spark, sf):
    return R.simple_returns(T.price_panel(spark, sf))


@query("returns_simple_all", f"WITH {GRID} SELECT ticker, date, {r8('r', 'r')} FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k FROM raw) WHERE k > 0")
def _(spark, sf):
    return R.simple_returns(T.price_panel(spark, sf), dropna="all")


@query("returns_log", f"WITH {GRID}, lg AS (SELECT ticker, date, ln(price) - lag(ln(price)) OVER (PARTITION BY ticker ORDER BY date) AS r FROM grid) SELECT ticker, date, {r8('r', 'r')} FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k, count(*) OVER (PARTITION BY date) AS n FROM lg) WHERE k = n")
def _(spark, sf):
    return R.log_returns(T.price_panel(spark, sf))


SPLIT = "CASE WHEN date >= DATE '1995-06-01' AND ticker = 'LARGE' THEN price / 4 WHEN date >= DATE '1996-06-01' AND ticker = 'SMALL' THEN price * 10 WHEN date >= DATE '1997-06-01' AND ticker = 'PROMO' THEN price * 1.8 ELSE price END"


@query("suspect_moves", f"""WITH {GRID.replace("panel AS (SELECT", "panel0 AS (SELECT", 1).replace("grid AS (", f"panel AS (SELECT ticker, date, {SPLIT} AS price FROM panel0)," + chr(10) + "grid AS (", 1)}, f AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for k in R.SPLIT_FACTORS for x in (k, 1.0 / k))}]) AS f),
hit AS (SELECT ticker, date, r, bool_or(abs((1 + r) / f - 1) <= 0.1) AS split FROM ret CROSS JOIN f GROUP BY 1, 2, 3)
SELECT ticker, date, {r8('r', 'r')}, CASE WHEN split THEN 'split' ELSE 'extreme' END AS reason FROM hit WHERE split OR abs(r) >= 0.75""")
def _(spark, sf):
    """The panel with two splits and a jump that is none planted in it."""
    return R.flag_suspect_moves(R.simple_returns(T.price_panel(spark, sf).withColumn("price", F.expr(SPLIT))))


@query("exposures", f"SELECT book, {r8('sum(abs(weight))', 'gross')}, {r8('sum(weight)', 'net')} FROM {values(BOOKS, 'book, ticker, weight')} GROUP BY book")
def _(spark, sf):
    return R.exposures(books(spark))


@query("book_returns", f"WITH {BOOKRET} SELECT book, date, {r8('r', 'r')} FROM bret")
def _(spark, sf):
    return book_ret(spark, sf)


@query("common_window", f"WITH {BOOKRET} SELECT book, date, {r8('r', 'r')} FROM bret WHERE date IN (SELECT date FROM bret GROUP BY date HAVING count(DISTINCT book) = (SELECT count(DISTINCT book) FROM bret))")
def _(spark, sf):
    return R.common_window(book_ret(spark, sf))


@query("missing_tickers", f"WITH {PANEL} SELECT ticker FROM (VALUES ('ECONOMY'), ('GHOST'), ('SMALL'), ('NOWHERE')) AS t(ticker) WHERE ticker NOT IN (SELECT ticker FROM panel)")
def _(spark, sf):
    return R.missing_tickers(literal(spark, [("ECONOMY",), ("GHOST",), ("SMALL",), ("NOWHERE",)], "ticker string"), T.price_panel(spark, sf))


@query("asset_returns", f"WITH {GRID} SELECT ticker, count(*) AS n, {r8('sum(r)', 'total')}, {r8('arg_max(r, date)', 'last_r')} FROM ret GROUP BY ticker")
def _(spark, sf):
    lists = R.asset_return_lists(R.simple_returns(T.price_panel(spark, sf)))
    return lists.select("ticker", F.size("r").alias("n"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("r", -1).alias("last_r"))


@query("market_on_book_dates", f"""WITH {BOOKRET}, m AS (SELECT date, r AS m FROM (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM panel WHERE ticker = 'STANDARD') WHERE r IS NOT NULL),
j AS (SELECT b.book, b.date, b.r, m.m, bool_and(m.m IS NOT NULL) OVER (PARTITION BY b.book) AS ok FROM bret b LEFT JOIN m ON m.date = b.date)
SELECT book, date, {r8('r', 'r')}, {r8('m', 'm')}, CASE WHEN ok THEN round(product(1 + m) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 8) END AS m_cumulative FROM j""")
def _(spark, sf):
    panel = T.price_panel(spark, sf)
    return R.market_on_book_dates(book_ret(spark, sf), R.simple_returns(panel.where("ticker = 'STANDARD'")))


# --- weights ------------------------------------------------------------------------------------------------------

WEIGHTS = """cents AS (SELECT c_mktsegment AS pf_name, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS trade_date, p_type AS ticker, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
pw AS (SELECT pf_name, CASE WHEN pf_name <> 'BUILDING' THEN 'exp-' || lower(pf_name) END AS experiment_id, CAST(NULL AS VARCHAR) AS branch, CAST(NULL AS VARCHAR) AS source, trade_date, ticker, cents / SUM(cents) OVER (PARTITION BY pf_name, trade_date) AS weight FROM cents)"""


@query("list_portfolios", f"WITH {WEIGHTS} SELECT pf_name, experiment_id, branch, source, min(trade_date) AS first_date, max(trade_date) AS last_date, count(DISTINCT trade_date) AS n_dates, count(DISTINCT ticker) AS n_tickers FROM pw GROUP BY ALL")
def _(spark, sf):
    return L.list_portfolios(T.portfolio_weights(spark, sf))


@query("asof_weights", f"WITH {WEIGHTS} SELECT ticker, trade_date, {r8('weight', 'weight')} FROM pw WHERE pf_name = 'BUILDING' AND experiment_id IS NULL AND trade_date = (SELECT max(trade_date) FROM pw WHERE pf_name = 'BUILDING' AND experiment_id IS NULL AND trade_date <= DATE '1997-06-15')")
def _(spark, sf):
    return L.weights_asof(T.portfolio_weights(spark, sf), "1997-06-15", "BUILDING").select("ticker", "trade_date", "weight")


@query("asof_all_books", f"WITH {WEIGHTS} SELECT pf_name, ticker, trade_date, {r8('weight', 'weight')} FROM (SELECT *, rank() OVER (PARTITION BY pf_name, experiment_id ORDER BY trade_date DESC) AS k FROM pw WHERE trade_date <= DATE '1998-01-01') WHERE k = 1")
def _(spark, sf):
    return L.weights_asof(T.portfolio_weights(spark, sf), "1998-01-01").select("pf_name", "ticker", "trade_date", "weight")


@query("turnover_by_date", f"""WITH {WEIGHTS}, d AS (SELECT pf_name, trade_date, lag(trade_date) OVER (PARTITION BY pf_name ORDER BY trade_date) AS before FROM (SELECT DISTINCT pf_name, trade_date FROM pw)),
old AS (SELECT d.pf_name, d.trade_date, pw.ticker, pw.weight FROM d JOIN pw ON pw.pf_name = d.pf_name AND pw.trade_date = d.before)
SELECT coalesce(n.pf_name, o.pf_name) AS pf_name, coalesce(n.trade_date, o.trade_date) AS trade_date, {r8('sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0)))', 'turnover')} FROM pw n FULL JOIN old o ON n.pf_name = o.pf_name AND n.trade_date = o.trade_date AND n.ticker = o.ticker GROUP BY 1, 2""")
def _(spark, sf):
    return P.rebalance_turnover(T.portfolio_weights(spark, sf))


@query("turnover_full_outer", f"SELECT {r8('sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)))', 'turnover')} FROM (SELECT * FROM {values(BOOKS, 'book, ticker, weight')} WHERE book = 'core') a FULL JOIN (SELECT * FROM {values(BOOKS, 'book, ticker, weight')} WHERE book = 'hedged') b ON a.ticker = b.ticker")
def _(spark, sf):
    return P.turnover(books(spark).where("book = 'core'"), books(spark).where("book = 'hedged'"))


@query("topk_weights", f"SELECT book, ticker, {r8('weight', 'weight')}, nr FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(weight) DESC, ticker) AS nr FROM {values(BOOKS, 'book, ticker, weight')}) WHERE nr <= 3")
def _(spark, sf):
    return P.top_weights(books(spark), 3)


# --- performance --------------------------------------------------------------------------------------------------


@query("cum_drawdown", f"WITH {RUNNING} SELECT book, date, {r8('r', 'r')}, {r8('cumulative', 'cumulative')}, {r8('drawdown', 'drawdown')} FROM curve")
def _(spark, sf):
    return P.cumulative(book_ret(spark, sf))


@query("perf_stats", f"""WITH {RUNNING}, g AS (SELECT book, product(1 + r) AS growth, stddev_samp(r) AS sd, min(drawdown) AS max_drawdown, count(*) AS n FROM curve GROUP BY book)
SELECT book, {r8('pow(growth, 252.0 / n) - 1', 'annual_return')}, {r8('sd * sqrt(252.0)', 'annual_vol')}, {r8('(pow(growth, 252.0 / n) - 1) / nullif(sd * sqrt(252.0), 0)', 'sharpe')}, {r8('growth - 1', 'total_return')}, {r8('max_drawdown', 'max_drawdown')}, n FROM g""")
def _(spark, sf):
    return P.performance_stats(book_ret(spark, sf))


@query("yearly_breakdown", f"WITH {BOOKRET} SELECT book, year(date) AS year, {r8('product(1 + r) - 1', 'r')} FROM bret GROUP BY 1, 2")
def _(spark, sf):
    return P.yearly(book_ret(spark, sf))


@query("deepest_drawdown", f"WITH {RUNNING} SELECT book, arg_min(date, (drawdown, date)) AS date, {r8('min(drawdown)', 'drawdown')} FROM curve GROUP BY book")
def _(spark, sf):
    return P.deepest_drawdown(book_ret(spark, sf))


LEGS_SQL = f"legs AS (SELECT ticker, position, w, w / sum(w) OVER (PARTITION BY position) AS share FROM {values(LEGS, 'ticker, position, w')})"


@query("long_short", f"""WITH {GRID}, {LEGS_SQL}, alldates AS (SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k FROM raw) WHERE k > 0),
leg AS (SELECT position, date, sum(coalesce(r, 0) * share) AS r FROM alldates JOIN legs USING (ticker) GROUP BY 1, 2),
s AS (SELECT date, max(CASE WHEN position = 'LONG' THEN r END) AS long, max(CASE WHEN position = 'SHORT' THEN r END) AS short FROM leg GROUP BY date)
SELECT date, {r8('long', 'long')}, {r8('short', 'short')}, {r8('long - short', 'spread')} FROM s""")
def _(spark, sf):
    return P.long_short(R.simple_returns(T.price_panel(spark, sf), dropna="all"), literal(spark, LEGS, "ticker string, position string, abs_weight double"))


LEG_SERIES = f"""{GRID}, {LEGS_SQL}, alldates AS (SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k FROM raw) WHERE k > 0),
leg AS (SELECT position, date, sum(coalesce(r, 0) * share) AS r FROM alldates JOIN legs USING (ticker) GROUP BY 1, 2),
bm AS (SELECT date, r FROM (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM panel WHERE ticker = 'STANDARD') WHERE r IS NOT NULL),
series AS (SELECT position AS series, date, r FROM leg WHERE r IS NOT NULL UNION ALL SELECT 'SPREAD', date, max(r) FILTER (WHERE position = 'LONG') - max(r) FILTER (WHERE position = 'SHORT') FROM leg GROUP BY date UNION ALL SELECT 'BENCHMARK', date, r FROM bm SEMI JOIN leg USING (date)),
wl AS (SELECT *, product(1 + r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM series WHERE r IS NOT NULL),
cv AS (SELECT series, date, r, w - 1 AS cumulative, w / greatest(max(w) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1 AS drawdown FROM wl)"""


def leg_series(spark, sf):
    panel = T.price_panel(spark, sf)
    market = R.simple_returns(panel.where("ticker = 'STANDARD'")).select("date", "r")
    return P.leg_series(R.simple_returns(panel, dropna="all"), literal(spark, LEGS, "ticker string, position string, abs_weight double"), market)


@query("leg_cumulative", f"WITH {LEG_SERIES} SELECT series, date, {r8('r', 'r')}, {r8('cumulative', 'cumulative')}, {r8('drawdown', 'drawdown')} FROM cv")
def _(spark, sf):
    return P.cumulative(leg_series(spark, sf), ["series"])


@query("leg_stats", f"""WITH {LEG_SERIES}, g AS (SELECT series, product(1 + r) AS growth, stddev_samp(r) AS sd, min(drawdown) AS max_drawdown, count(*) AS n FROM cv GROUP BY series)
SELECT series, {r8('pow(growth, 252.0 / n) - 1', 'annual_return')}, {r8('sd * sqrt(252.0)', 'annual_vol')}, {r8('(pow(growth, 252.0 / n) - 1) / nullif(sd * sqrt(252.0), 0)', 'sharpe')}, {r8('growth - 1', 'total_return')}, {r8('max_drawdown', 'max_drawdown')}, n FROM g""")
def _(spark, sf):
    return P.performance_stats(leg_series(spark, sf), ["series"])


@query("leg_equal_weight", f"""WITH {GRID}, {LEGS_SQL}, alldates AS (SELECT * FROM (SELECT *, count(r) OVER (PARTITION BY date) AS k FROM raw) WHERE k > 0)
SELECT position, date, {r8('avg(r)', 'r')} FROM alldates JOIN legs USING (ticker) GROUP BY 1, 2""")
def _(spark, sf):
    return P.leg_returns(R.simple_returns(T.price_panel(spark, sf), dropna="all"), literal(spark, LEGS, "ticker string, position string, abs_weight double").drop("abs_weight"))


@query("realized_beta", f"""WITH {BOOKRET}, m AS (SELECT date, r AS m FROM (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM panel WHERE ticker = 'STANDARD') WHERE r IS NOT NULL)
SELECT book, {r8('regr_slope(r, m)', 'beta')}, {r8('regr_intercept(r, m)', 'alpha')}, {r8('regr_r2(r, m)', 'r2')}, count(*) AS n FROM bret JOIN m USING (date) GROUP BY book""")
def _(spark, sf):
    m = R.simple_returns(T.price_panel(spark, sf).where("ticker = 'STANDARD'")).select("date", F.col("r").alias("m"))
    return P.realized_beta(book_ret(spark, sf).join(m, "date", "left"), "r", "m")


# --- VaR, ES, backtests -------------------------------------------------------------------------------------------

FRAME = f"(PARTITION BY book ORDER BY date ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)"


def param(alpha: float) -> str:
    z = V._NORMAL.inv_cdf(alpha)
    return BOOKRET + f""",
fc AS (SELECT * FROM (SELECT book, date, r, -(avg(r) OVER {FRAME} + ({z}) * stddev_samp(r) OVER {FRAME}) AS var, -(avg(r) OVER {FRAME} - stddev_samp(r) OVER {FRAME} * {V._NORMAL.pdf(z) / alpha}) AS es, row_number() OVER (PARTITION BY book ORDER BY date) AS nr FROM bret) WHERE nr > {W})"""


def hist(alpha: float) -> str:
    return BOOKRET + f""",
pool AS (SELECT book, date, r, quantile_cont(r, {alpha}) OVER {FRAME} AS q, list(r) OVER {FRAME} AS xs, row_number() OVER (PARTITION BY book ORDER BY date) AS nr FROM bret),
fc AS (SELECT book, date, r, -q AS var, coalesce(-list_avg(list_filter(xs, lambda x: x < q)), -q) AS es FROM pool WHERE nr > {W})"""


PARAM, HIST = param(ALPHA), hist(ALPHA)
EWMA = BOOKRET.replace("WITH ", "") + f""",
n AS (SELECT book, date, r, row_number() OVER (PARTITION BY book ORDER BY date) AS i FROM bret),
seed AS (SELECT book, var_pop(r) AS s0 FROM n WHERE i <= {W} GROUP BY book),
sig AS (SELECT n.book, n.date, n.r, n.i, pow(0.94, n.i - 1) * s0 + coalesce(0.06 * pow(0.94, n.i - 1) * sum(n.r * n.r / pow(0.94, n.i)) OVER (PARTITION BY n.book ORDER BY n.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sigma2 FROM n JOIN seed USING (book))"""
def fhs(alpha: float) -> str:
    return EWMA + f""",
z AS (SELECT *, r / sqrt(sigma2) AS z FROM sig),
pool AS (SELECT book, date, r, i, sigma2, quantile_cont(z, {alpha}) OVER {FRAME} AS q, list(z) OVER {FRAME} AS xs FROM z),
fc AS (SELECT book, date, r, -q * sqrt(sigma2) AS var, -list_avg(list_filter(xs, lambda x: x <= q)) * sqrt(sigma2) AS es FROM pool WHERE i > {W})"""


FHS = fhs(ALPHA)
FC = f"SELECT book, date, {r8('r', 'r')}, {r8('var', 'var')}, {r8('es', 'es')} FROM fc"


@query("rolling_param_var", f"WITH {PARAM} {FC}")
def _(spark, sf):
    return V.rolling_parametric(book_ret(spark, sf), W, ALPHA)


@query("rolling_hist_es", f"WITH {HIST} {FC}")
def _(spark, sf):
    return V.rolling_historic(book_ret(spark, sf), W, ALPHA)


@query("ewma_filter", f"WITH {EWMA} SELECT book, date, {r8('r', 'r')}, {r8('sigma2', 'sigma2')}, {r8('r / sqrt(sigma2)', 'z')} FROM sig")
def _(spark, sf):
    return V.ewma_filter(book_ret(spark, sf), 0.94, V.var_pop_of(W))


@query("fhs_var_es", f"WITH {FHS} {FC}")
def _(spark, sf):
    return V.rolling_fhs(book_ret(spark, sf), W, ALPHA)


def _conf(c=0.99):
    z = V._NORMAL.inv_cdf(c)
    return z, V._NORMAL.pdf(z) / (1 - c)


@query("rolling_confidence_var", f"""WITH {BOOKRET}, m AS (SELECT book, date, r, CASE WHEN count(r) OVER {FRAME} = {W} THEN avg(r) OVER {FRAME} END AS mu, CASE WHEN count(r) OVER {FRAME} = {W} THEN stddev_samp(r) OVER {FRAME} END AS sigma FROM bret)
SELECT book, date, {r8('r', 'r')}, {r8('mu', 'mu')}, {r8('sigma', 'sigma')}, {r8(f'{_conf()[0]} * sigma - mu', 'var')}, {r8(f'{_conf()[1]} * sigma - mu', 'es')} FROM m""")
def _(spark, sf):
    return V.rolling_confidence(book_ret(spark, sf), 0.99, W)


@query("rolling_ewma_var", f"""WITH {BOOKRET}, n AS (SELECT book, date, r, row_number() OVER (PARTITION BY book ORDER BY date) AS i, first_value(r) OVER (PARTITION BY book ORDER BY date) AS r0 FROM bret),
lv AS (SELECT book, date, r, i, pow(0.94, i - 1) * r0 * r0 + 0.06 * pow(0.94, i) * (sum(r * r / pow(0.94, i)) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r0 * r0 / 0.94) AS level FROM n),
m AS (SELECT book, date, r, CASE WHEN count(r) OVER {FRAME} = {W} THEN avg(r) OVER {FRAME} END AS mu, CASE WHEN count(r) OVER {FRAME} = {W} THEN sqrt(lag(level) OVER (PARTITION BY book ORDER BY date)) END AS sigma FROM lv)
SELECT book, date, {r8('r', 'r')}, {r8('mu', 'mu')}, {r8('sigma', 'sigma')}, {r8(f'{_conf()[0]} * sigma - mu', 'var')}, {r8(f'{_conf()[1]} * sigma - mu', 'es')} FROM m""")
def _(spark, sf):
    return V.rolling_confidence(book_ret(spark, sf), 0.99, W, "ewma")


XL = lambda x, y: f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END)"


def tested(fc: str) -> str:
    return fc + ", hit AS (SELECT *, CASE WHEN r < -var THEN 1 ELSE 0 END AS breach FROM fc)"


def lr_sql(alpha: float, n: str = "b", t: str = "t") -> str:
    return f"(-2 * ({XL(f'({t} - {n})', str(1 - alpha))} + {XL(n, str(alpha))} - {XL(f'({t} - {n})', f'(1 - {n} / {t})')} - {XL(n, f'({n} / {t})')}))"


def coverage(alpha: float) -> str:
    """u: breaches, days, ratio and its upper tail (series of the error function with log-gamma terms)."""
    y = "sqrt(greatest(lr, 0) / 2)"
    tail = f"CASE WHEN lr <= 1e-300 THEN 1.0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-greatest(lr, 0) / 2) * list_sum(list_transform(generate_series(0, 200), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln({y}) + lgamma(n + 1) - lgamma(2 * n + 2))))) END"
    return f"k AS (SELECT book, CAST(sum(breach) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS t FROM hit GROUP BY book), u0 AS (SELECT book, b, t, {lr_sql(alpha)} AS lr FROM k), u AS (SELECT *, {tail} AS pu FROM u0)"


def uc_columns(alpha: float) -> str:
    return f"CAST(b AS BIGINT) AS breaches, CAST(t AS BIGINT) AS days, {r8('lr', 'lr_uc')}, {r8('pu', 'p_uc')}, {r8('b / t', 'rate')}, CAST({alpha} AS DOUBLE) AS expected_rate, lr > 3.841 AS reject_uc"


@query("kupiec", f"WITH {tested(HIST)}, {coverage(ALPHA)} SELECT book, {uc_columns(ALPHA)} FROM u")
def _(spark, sf):
    return B.kupiec(B.breaches(V.rolling_historic(book_ret(spark, sf), W, ALPHA)), ALPHA)


XP = lambda n, p: f"(CASE WHEN {n} > 0 AND {p} > 0 THEN {n} * ln({p}) ELSE 0.0 END)"
CHRIS = """tr AS (SELECT book, breach, lag(breach) OVER (PARTITION BY book ORDER BY date) AS before FROM hit),
c AS (SELECT book, """ + ", ".join(f"CAST(sum(CASE WHEN before = {a} AND breach = {b} THEN 1 ELSE 0 END) AS DOUBLE) AS n{a}{b}" for a in (0, 1) for b in (0, 1)) + """ FROM tr GROUP BY book),
p AS (SELECT *, coalesce(n01 / nullif(n00 + n01, 0), 0) AS p01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS p11, coalesce((n10 + n11) / nullif(n00 + n01 + n10 + n11, 0), 0) AS pi FROM c),
i AS (SELECT *, -2 * (""" + XP("(n00 + n10)", "(1 - pi)") + " + " + XP("(n01 + n11)", "pi") + " - " + XP("n00", "(1 - p01)") + " - " + XP("n01", "p01") + " - " + XP("n10", "(1 - p11)") + " - " + XP("n11", "p11") + ") AS li FROM p)"
CC_COLUMNS = f"CAST(n00 AS BIGINT) AS n00, CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(n11 AS BIGINT) AS n11, {r8('p01', 'pi01')}, {r8('p11', 'pi11')}, {r8('li', 'lr_ind')}, {r8('lr + li', 'lr_cc')}, {r8('exp(-(lr + li) / 2)', 'p_cc')}, lr + li > 5.991 AS reject_cc"


@query("christoffersen", f"WITH {tested(PARAM)}, {coverage(ALPHA)}, {CHRIS} SELECT book, {uc_columns(ALPHA)}, {CC_COLUMNS} FROM u JOIN i USING (book)")
def _(spark, sf):
    return B.christoffersen(B.breaches(V.rolling_parametric(book_ret(spark, sf), W, ALPHA)), ALPHA)


def acerbi(alpha: float) -> str:
    return f"a AS (SELECT book, count(*) AS n_days, sum(CASE WHEN breach = 1 THEN r / ({alpha} * es) END) AS s, avg(CASE WHEN breach = 1 THEN es END) AS me, avg(CASE WHEN breach = 1 THEN -r END) AS ml FROM hit GROUP BY book)"


Z2_COLUMNS = f"{r8('me', 'mean_es')}, {r8('ml', 'mean_loss')}, {r8('CASE WHEN b > 0 THEN s / n_days + 1 ELSE 0.0 END', 'z2')}, {r8('ml / me', 'es_ratio')}"


@query("acerbi_z2", f"WITH {tested(HIST)}, {coverage(ALPHA)}, {acerbi(ALPHA)} SELECT book, CAST(t AS BIGINT) AS days, CAST(b AS BIGINT) AS breaches, {Z2_COLUMNS} FROM a JOIN u USING (book)")
def _(spark, sf):
    return B.acerbi_z2(B.breaches(V.rolling_historic(book_ret(spark, sf), W, ALPHA)), ALPHA)


@query("rolling_breaches", f"WITH {tested(PARAM)} SELECT book, date, CASE WHEN count(*) OVER w = 63 THEN CAST(sum(breach) OVER w AS BIGINT) END AS breaches, {r8(f'CAST({63 * ALPHA} AS DOUBLE)', 'expected')} FROM hit WINDOW w AS (PARTITION BY book ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return P.rolling_breaches(B.breaches(V.rolling_parametric(book_ret(spark, sf), W, ALPHA)), ALPHA).select("book", "date", "breaches", "expected")


N_BOOT = 3000


def simulated(alpha: float, n_boot: int = N_BOOT, seed: int = 42) -> str:
    """zp: p-value and mean of the simulated Z2, from hit, a and u; every draw and day a row, written down from the test's definition."""
    draws = f"(SELECT i, unnest(generate_series(1, {n_boot})) AS d FROM (SELECT DISTINCT i FROM hn))"
    drawn = with_uniform_sql(f"(SELECT * FROM ({with_uniform_sql(draws, 'u', ['d', 'i', 1], seed)}) WHERE u < {alpha})", "e", ["d", "i", 2], seed)
    return f"""hn AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY date) AS i FROM hit), dr AS ({drawn}),
ob AS (SELECT book, b, n_days, CASE WHEN b > 0 THEN s / n_days + 1 ELSE 0.0 END AS z2 FROM a JOIN u USING (book)),
zs AS (SELECT book, d, sum(-(var - ln(e) * greatest(es - var, 1e-12)) / ({alpha} * es)) / any_value(n_days) + 1 AS z FROM hn JOIN dr USING (i) JOIN ob USING (book) GROUP BY 1, 2),
za AS (SELECT ob.book, unnest(generate_series(1, {n_boot})) AS d, z2, CASE WHEN (SELECT bool_or(var < 0) FROM hit h WHERE h.book = ob.book) THEN 1.0 ELSE 0.0 END AS calm FROM ob),
zp AS (SELECT book, avg(CASE WHEN coalesce(z, calm) <= z2 THEN 1.0 ELSE 0.0 END) AS p_value, avg(coalesce(z, calm)) AS boot_mean FROM za LEFT JOIN zs USING (book, d) GROUP BY book)"""


FORECASTS = {"parametric": param, "historic": hist, "fhs": fhs}
GRID_CELLS = " UNION ALL ".join(
    f"(WITH {tested(FORECASTS[m](a))}, {coverage(a)}, {CHRIS}, {acerbi(a)}, {simulated(a)} SELECT book, '{m}' AS method, CAST({a} AS DOUBLE) AS alpha, b, t, {uc_columns(a)}, {CC_COLUMNS}, {Z2_COLUMNS}, {r8(f't * {a}', 'expected_breaches')}, {r8('p_value', 'p_value')}, {r8('boot_mean', 'boot_mean')}, p_value < 0.05 AS reject_z2 FROM u JOIN i USING (book) JOIN a USING (book) JOIN zp USING (book))"
    for m in FORECASTS for a in (0.01, 0.05)
)


@query("full_grid", f"SELECT * EXCLUDE (b, t) FROM ({GRID_CELLS})")
def _(spark, sf):
    return B.full_grid(book_ret(spark, sf), W)


@query("multi_backtest", f"""SELECT book, method, alpha, rate AS breach_rate, breaches AS breach_n, reject_uc AS kupiec_reject, reject_cc AS christ_reject, n11, mean_loss AS es_real, mean_es AS es_pred, es_ratio, z2 AS acerbi_z2, p_value AS acerbi_p, reject_z2 AS acerbi_reject, period_start, period_end, obs, gross, net, beta, beta_alpha, r2, beta_n
FROM ({GRID_CELLS}) JOIN (WITH {BOOKRET} SELECT book, min(date) AS period_start, max(date) AS period_end, count(*) AS obs FROM bret GROUP BY book) USING (book)
JOIN (SELECT book, {r8('sum(abs(weight))', 'gross')}, {r8('sum(weight)', 'net')} FROM {values(BOOKS, 'book, ticker, weight')} GROUP BY book) USING (book)
JOIN (WITH {BOOKRET}, m AS (SELECT date, r AS m FROM (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM panel WHERE ticker = 'STANDARD') WHERE r IS NOT NULL) SELECT book, {r8('regr_slope(r, m)', 'beta')}, {r8('regr_intercept(r, m)', 'beta_alpha')}, {r8('regr_r2(r, m)', 'r2')}, count(*) AS beta_n FROM bret JOIN m USING (date) GROUP BY book) USING (book)
WHERE method <> 'fhs'""")
def _(spark, sf):
    return B.multi_backtest(T.price_panel(spark, sf), books(spark), "STANDARD", W)


@query("bootstrap_ci", f"""WITH {BOOKRET}, pool AS (SELECT book, list_sort(list(r)) AS xs, count(*) AS n FROM bret GROUP BY book),
pl AS ({with_uniform_sql("(SELECT n, d, unnest(generate_series(1, n)) AS j FROM (SELECT DISTINCT n, d FROM pool, (SELECT unnest(generate_series(1, 5000)) AS d)))", "u", ["d", "j"], 42)}),
od AS (SELECT n, d, list_sort(list(CAST(floor(u * n) AS BIGINT))) AS a FROM pl GROUP BY n, d),
en AS (SELECT n, d, a[CAST(floor((n - 1) * {ALPHA}) AS BIGINT) + 1] AS lo, a[CAST(floor((n - 1) * {ALPHA}) AS BIGINT) + 2] AS hi, (n - 1) * {ALPHA} - floor((n - 1) * {ALPHA}) AS part FROM od),
qs AS (SELECT book, xs[lo + 1] + (xs[hi + 1] - xs[lo + 1]) * part AS q FROM pool JOIN en USING (n)), sp AS (SELECT book, stddev_pop(q) AS se, quantile_cont(q, 0.025) AS lo, quantile_cont(q, 0.975) AS hi FROM qs GROUP BY book)
SELECT book, (SELECT round(quantile_cont(r, {ALPHA}), 8) FROM bret b WHERE b.book = sp.book) AS point, {r8('se', 'se')}, {r8('lo', 'lo')}, {r8('hi', 'hi')} FROM sp""")
def _(spark, sf):
    return V.bootstrap_quantile(book_ret(spark, sf), ALPHA)


_PART, _PART_ONE = quantile_ranks(W, ALPHA)[2], quantile_ranks(1000, ALPHA)[2]


@query("fhs_bootstrap", f"""WITH {EWMA}, z AS (SELECT *, r / sqrt(sigma2) AS z FROM sig), ordered AS (SELECT book, date, r, i, sigma2, list_sort(list(z) OVER {FRAME}) AS xs FROM z),
rk AS ({resampled_ranks_sql(W, W, 1000, ALPHA, 42)}), one AS ({resampled_ranks_sql(W, 1000, 1, ALPHA, 43)}),
bag AS (SELECT place, sum(w) / 1000 AS w FROM (SELECT low AS place, {1 - _PART} AS w FROM rk UNION ALL SELECT high, {_PART} FROM rk) GROUP BY place),
qq AS (SELECT book, date, sum(w * xs[place + 1]) AS q FROM (SELECT * FROM ordered WHERE i > {W}) CROSS JOIN bag GROUP BY 1, 2),
tl AS (SELECT o.*, q, list_filter(xs, lambda x: x <= xs[low + 1] + (xs[high + 1] - xs[low + 1]) * {_PART_ONE}) AS tail FROM ordered o JOIN qq USING (book, date) CROSS JOIN one)
SELECT book, date, {r8('r', 'r')}, {r8('-q * sqrt(sigma2)', 'var')}, {r8('-list_avg(tail) * sqrt(sigma2)', 'es')}, CAST(len(tail) AS BIGINT) AS n_tail FROM tl""")
def _(spark, sf):
    return V.rolling_fhs_bootstrap(book_ret(spark, sf), W, ALPHA)


@query("acerbi_p_value", f"WITH {tested(HIST)}, {coverage(ALPHA)}, {acerbi(ALPHA)}, {simulated(ALPHA, 10_000)} SELECT book, CAST(b AS BIGINT) AS breaches, {r8('z2', 'z2')}, {r8('p_value', 'p_value')}, {r8('boot_mean', 'boot_mean')}, p_value < 0.05 AS reject_z2 FROM ob JOIN zp USING (book)")
def _(spark, sf):
    return B.acerbi_p_value(B.breaches(V.rolling_historic(book_ret(spark, sf), W, ALPHA)), ALPHA)


# --- regime -------------------------------------------------------------------------------------------------------

MACRO = {"vix": "ECONOMY", "dxy": "PROMO", "hyg": "LARGE", "ief": "MEDIUM"}
ZF = lambda c: f"CASE WHEN count({c}) OVER f = {W} AND stddev_samp({c}) OVER f > 0 THEN ({c} - avg({c}) OVER f) / stddev_samp({c}) OVER f END"
tri = lambda i, j: f"m{min(i, j)}{max(i, j)}"
TRI = [tri(i, j) for i in range(4) for j in range(i, 4)]
REGIME = PANEL + f""",
wide0 AS (SELECT date, {', '.join(f"max(CASE WHEN ticker = '{t}' THEN price END) AS {k}" for k, t in MACRO.items())} FROM panel GROUP BY date),
wide AS (SELECT *, hyg / ief AS credit FROM wide0 WHERE vix IS NOT NULL AND dxy IS NOT NULL AND hyg IS NOT NULL AND ief IS NOT NULL),
zz AS (SELECT date, row_number() OVER (ORDER BY date) AS days, {', '.join(f'{ZF(c)} AS {c}_z' for c in ('vix', 'dxy', 'ief', 'credit'))} FROM wide WINDOW f AS (ORDER BY date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
zn AS (SELECT * FROM zz WHERE vix_z IS NOT NULL AND dxy_z IS NOT NULL AND ief_z IS NOT NULL AND credit_z IS NOT NULL),
cz AS (SELECT *, {', '.join(f'covar_samp({a}, {b}) OVER h AS m{i}{j}' for i, a in enumerate(G.Z_NAMES) for j, b in enumerate(G.Z_NAMES) if i <= j)} FROM zn WINDOW h AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sq AS (SELECT date, 0 AS k, {', '.join(f'{m} / (m00 + m11 + m22 + m33) AS {m}' for m in TRI)} FROM cz WHERE m00 IS NOT NULL UNION ALL
  SELECT date, k + 1, {', '.join(f"({' + '.join(f'{tri(i, q)} * {tri(q, j)}' for q in range(4))}) / t" for i in range(4) for j in range(i, 4))} FROM (SELECT *, {' + '.join(f'{tri(i, j)} * {tri(i, j)}' for i in range(4) for j in range(4))} AS t FROM sq) WHERE k < 32),
ax AS (SELECT date, {', '.join(f"CASE greatest(m00, m11, m22, m33) {' '.join(f'WHEN m{i}{i} THEN {tri(i, j)}' for i in range(4))} END AS a{j}" for j in range(4))} FROM sq WHERE k = 32),
zs AS (SELECT zz.*, CASE WHEN a0 < 0 THEN -1 ELSE 1 END * (a0 * vix_z + a1 * dxy_z + a2 * ief_z + a3 * credit_z) / sqrt(a0 * a0 + a1 * a1 + a2 * a2 + a3 * a3) AS pca_factor FROM zz LEFT JOIN ax USING (date)),
sc AS (SELECT *, CASE WHEN pca_factor IS NOT NULL THEN greatest(0.0, least(100.0, 50 - 12 * vix_z - 8 * dxy_z - 6 * ief_z - 6 * pca_factor - 20 / (1 + exp(-1.2 * vix_z)) + CASE WHEN credit_z >= 0 THEN 5 * credit_z ELSE -15 * abs(credit_z) END)) END AS score,
  concat_ws(', ', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in (*G.Z_NAMES, 'pca_factor'))}) AS unresolved FROM zs),
lk AS (SELECT *, {', '.join(f'exp(-0.5 * pow((score - {m}) / 15.0, 2)) AS l{i}' for i, m in enumerate(G.MIXTURE_MEANS))} FROM sc),
po AS (SELECT *, l0 / (l0 + l1 + l2) AS posterior_risk_off, l1 / (l0 + l1 + l2) AS posterior_soft_patch, l2 / (l0 + l1 + l2) AS posterior_risk_on FROM lk),
reg AS (SELECT *, 100 + 40 * (posterior_risk_on - posterior_risk_off) AS gross_target, 0.3 + 0.4 * (posterior_risk_on - posterior_risk_off) AS beta_cap,
  CASE WHEN score IS NULL THEN NULL WHEN posterior_risk_off >= posterior_soft_patch AND posterior_risk_off >= posterior_risk_on THEN 'risk_off' WHEN posterior_soft_patch >= posterior_risk_on THEN 'soft_patch' ELSE 'risk_on' END AS label FROM po)"""
REG_COLS = (*G.Z_NAMES, "pca_factor", "score", "posterior_risk_off", "posterior_soft_patch", "posterior_risk_on", "gross_target", "beta_cap")


def regime(spark, sf):
    return G.regime_table(T.price_panel(spark, sf), W, MACRO)


@query("regime_table", f"WITH RECURSIVE {REGIME} SELECT date, days, {', '.join(r8(c, c) for c in REG_COLS)}, label, unresolved FROM reg")
def _(spark, sf):
    return regime(spark, sf)


@query("regime_asof", f"WITH RECURSIVE {REGIME} SELECT date, days, {', '.join(r8(c, c) for c in REG_COLS)}, label, unresolved FROM reg WHERE date <= DATE '1997-06-30' ORDER BY date DESC LIMIT 1")
def _(spark, sf):
    return G.regime_asof(regime(spark, sf), "1997-06-30", W)


@query("rolling_zscores", f"WITH {PANEL} SELECT ticker, date, {r8('price', 'price')}, round({ZF('price')}, 8) AS z FROM panel WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return G.rolling_zscore(T.price_panel(spark, sf), "price", W, ["ticker"])


@query("trailing_zscore", f"WITH {PANEL}, z AS (SELECT ticker, date, {ZF('price')} AS z FROM panel WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)) SELECT ticker, {r8('z', 'z')} FROM z QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def _(spark, sf):
    return G.trailing_zscore(T.price_panel(spark, sf), "price", W, ["ticker"])


FWD = ", ".join(f"CASE WHEN count(r) OVER w{h} = {h} THEN product(1 + r) OVER w{h} - 1 END AS fwd_{h}" for h in (1, 5, 21))
FWD_W = ", ".join(f"w{h} AS (PARTITION BY book ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in (1, 5, 21))


@query("forward_returns", f"WITH {BOOKRET}, f AS (SELECT book, date, r, {FWD} FROM bret WINDOW {FWD_W}) SELECT book, date, {r8('r', 'r')}, {', '.join(r8(f'fwd_{h}', f'fwd_{h}') for h in (1, 5, 21))} FROM f")
def _(spark, sf):
    return G.forward_returns(book_ret(spark, sf))


@query("regime_buckets", f"""WITH RECURSIVE {REGIME}, s AS (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS r FROM panel WHERE ticker = 'STANDARD'), bret AS (SELECT label AS lb, 'spy' AS book, s.date, s.r, label FROM s JOIN reg USING (date) WHERE s.r IS NOT NULL AND label IS NOT NULL),
f AS (SELECT label, {FWD} FROM bret WINDOW {FWD_W}), l AS ({' UNION ALL '.join(f'SELECT label, {h} AS horizon, fwd_{h} AS x FROM f' for h in (1, 5, 21))})
SELECT label, CAST(horizon AS BIGINT) AS horizon, {r8('avg(x)', 'mean')}, count(x) AS n FROM l GROUP BY label, horizon HAVING count(x) > 0""")
def _(spark, sf):
    spy = R.simple_returns(T.price_panel(spark, sf).where("ticker = 'STANDARD'")).select("date", "r")
    joined = spy.join(regime(spark, sf).where("unresolved = ''").select("date", "label"), "date").withColumn("book", F.lit("spy"))
    return G.bucket_stats(G.forward_returns(joined))


@query("pc1_score", f"WITH RECURSIVE {REGIME} SELECT {r8('arg_max(pca_factor, date)', 'pc1')} FROM reg")
def _(spark, sf):
    return G.pc1_score(regime(spark, sf), G.Z_NAMES, G.Z_NAMES[0])


# --- covariance and models ----------------------------------------------------------------------------------------

COV = GRID + ", cv AS (SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, covar_samp(a.r, b.r) AS cov FROM ret a JOIN ret b USING (date) GROUP BY 1, 2)"


def covariance(spark, sf, scale=1.0):
    return C.sample_covariance(R.simple_returns(T.price_panel(spark, sf)), scale)


@query("sample_cov", f"WITH {COV} SELECT ticker_i, ticker_j, {r8('cov * 1e6', 'cov')} FROM cv")
def _(spark, sf):
    return covariance(spark, sf, 1e6)


@query("portfolio_sigma", f"WITH {COV}, b AS (SELECT * FROM {values(BOOKS, 'book, ticker, weight')}) SELECT x.book, {r8('sqrt(sum(x.weight * cov * y.weight))', 'sigma')} FROM b x JOIN cv ON x.ticker = ticker_i JOIN b y ON y.book = x.book AND y.ticker = ticker_j GROUP BY x.book")
def _(spark, sf):
    return V.portfolio_sigma(books(spark), covariance(spark, sf))


FULLCOV = f"tri AS (SELECT * FROM {values(TRIANGLE, 'factor_i, factor_j, cov')}), fcov AS (SELECT * FROM tri UNION ALL SELECT factor_j, factor_i, cov FROM tri WHERE factor_i <> factor_j)"


@query("factor_cov_mirror", f"WITH {FULLCOV} SELECT factor_i, factor_j, {r8('cov', 'cov')} FROM fcov")
def _(spark, sf):
    return L.mirror_factor_cov(literal(spark, TRIANGLE, "factor_i string, factor_j string, cov double"))


@query("factor_model_cov", f"""WITH {FULLCOV}, be AS (SELECT * FROM {values(BETAS, 'ticker, factor, beta')}), re AS (SELECT * FROM {values(RESID, 'ticker, resid_var')})
SELECT x.ticker AS ticker_i, y.ticker AS ticker_j, {r8('sum(x.beta * cov * y.beta) + coalesce(max(re.resid_var), 0)', 'cov')} FROM be x JOIN fcov ON x.factor = factor_i JOIN be y ON y.factor = factor_j LEFT JOIN re ON re.ticker = x.ticker AND x.ticker = y.ticker GROUP BY 1, 2""")
def _(spark, sf):
    cov = L.mirror_factor_cov(literal(spark, TRIANGLE, "factor_i string, factor_j string, cov double"))
    b, c, d = L.align_factor_model(literal(spark, BETAS, "ticker string, factor string, beta double"), cov, literal(spark, RESID, "ticker string, resid_var double"))
    return C.factor_model_covariance(b, c, d)


FACTOR_ROWS = "rw AS (SELECT p_type AS ticker, l_returnflag AS factor, make_date(year(l_shipdate), 12, 31) AS asof_date, l_linenumber AS loaded, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("factor_betas_asof", f"WITH {FACTOR_ROWS}, b AS (SELECT ticker, factor, loaded, avg(l_discount) * 20 AS beta FROM rw WHERE asof_date = DATE '1996-12-31' GROUP BY 1, 2, 3) SELECT ticker, factor, {r8('arg_max(beta, loaded)', 'beta')} FROM b GROUP BY 1, 2")
def _(spark, sf):
    return L.factor_betas(T.factor_tables(spark, sf)[0], "1996-12-31", TICKERS, 252, "v1", ["loaded"])


@query("residual_variances_asof", f"WITH {FACTOR_ROWS}, v AS (SELECT ticker, loaded, var_samp(l_tax) AS v FROM rw WHERE asof_date = DATE '1996-12-31' GROUP BY 1, 2) SELECT ticker, {r8('arg_min(v, loaded)', 'resid_var')} FROM v GROUP BY 1")
def _(spark, sf):
    return L.residual_variances(T.factor_tables(spark, sf)[1], "1996-12-31", TICKERS, 252, "ewma", ["loaded"])


MODELS_SQL = f"models AS (SELECT * FROM {values(MODELS, 'model_id, ticker, weight')})"


@query("tracking_error", f"WITH {COV}, {MODELS_SQL}, d AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM (SELECT * FROM models WHERE model_id = 'GROWTH') a FULL JOIN (SELECT * FROM models WHERE model_id = 'INCOME') b ON a.ticker = b.ticker) SELECT {r8('sqrt(sum(x.d * cov * y.d))', 'te')} FROM d x JOIN cv ON x.ticker = ticker_i JOIN d y ON y.ticker = ticker_j")
def _(spark, sf):
    return C.tracking_error(one_model(spark, "GROWTH"), one_model(spark, "INCOME"), covariance(spark, sf))


@query("compare_models", f"""WITH {MODELS_SQL}, s AS (SELECT * FROM {values(SLEEVES, 'ticker, sleeve')}), d AS (SELECT ticker, coalesce(a.weight, 0) AS o, coalesce(b.weight, 0) AS n FROM (SELECT * FROM models WHERE model_id = 'GROWTH') a FULL JOIN (SELECT * FROM models WHERE model_id = 'INCOME') b USING (ticker))
SELECT ticker, {r8('o', 'old')}, {r8('n', 'new')}, {r8('n - o', 'diff')}, abs(n - o) > 0.0005 AS changed, sleeve FROM d LEFT JOIN s USING (ticker)""")
def _(spark, sf):
    return C.compare_models(one_model(spark, "GROWTH"), one_model(spark, "INCOME"), literal(spark, SLEEVES, "ticker string, sleeve string"))


@query("model_change_flows", f"""WITH {MODELS_SQL}, d AS (SELECT coalesce(b.weight, 0) - coalesce(a.weight, 0) AS d FROM (SELECT * FROM models WHERE model_id = 'GROWTH') a FULL JOIN (SELECT * FROM models WHERE model_id = 'INCOME') b USING (ticker))
SELECT {r8('sum(abs(d)) / 2', 'turnover')}, CAST(sum(CASE WHEN abs(d) > 0.0005 THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, {r8('sum(greatest(d, 0)) * 1000', 'bought')}, {r8('sum(greatest(-d, 0)) * 1000', 'sold')} FROM d""")
def _(spark, sf):
    return C.model_change(C.compare_models(one_model(spark, "GROWTH"), one_model(spark, "INCOME")), 1000.0)


@query("round_to_grid", f"""WITH {WEIGHTS}, f AS (SELECT pf_name, trade_date, ticker, weight, greatest(weight, 0) * 200 AS u FROM pw), k AS (SELECT *, 200 - sum(floor(u + 1e-9)) OVER (PARTITION BY pf_name, trade_date) AS rest, row_number() OVER (PARTITION BY pf_name, trade_date ORDER BY u - floor(u + 1e-9) DESC, ticker) AS nr FROM f)
SELECT pf_name, trade_date, ticker, {r8('weight', 'weight')}, {r8('(floor(u + 1e-9) + CASE WHEN nr <= rest THEN 1 ELSE 0 END) / 200', 'rounded')} FROM k""")
def _(spark, sf):
    return C.round_to_grid(T.portfolio_weights(spark, sf).select("pf_name", "trade_date", "ticker", "weight"), 0.005, ("pf_name", "trade_date"))


BOOK_YEAR, FLOOR = ("book", "year"), 0.0115
mul = lambda a, b: f"SELECT a.book, a.year, a.i, b.j, sum(a.v * b.v) AS v FROM {a} a JOIN {b} b ON a.book = b.book AND a.year = b.year AND a.j = b.i GROUP BY ALL"
# eigenvalues below the floor are those where the sign of (matrix - floor) is -1; that sign by Newton's iteration x (3 - x^2) / 2
CLIPPED = PANEL + f""",
books AS (SELECT * FROM {values(BOOKS, 'book, ticker, weight')}),
own AS (SELECT book, year(date) AS year, date, ticker, price FROM panel JOIN books USING (ticker)),
wd AS (SELECT book, year, date, ticker, price FROM (SELECT *, count(*) OVER (PARTITION BY book, date) AS k FROM own) JOIN (SELECT book, year, count(DISTINCT ticker) AS n FROM own GROUP BY 1, 2) USING (book, year) WHERE k = n),
rr AS (SELECT * FROM (SELECT *, price / lag(price) OVER (PARTITION BY book, year, ticker ORDER BY date) - 1 AS r FROM wd) WHERE r IS NOT NULL),
cy AS (SELECT a.book, a.year, a.ticker AS i, b.ticker AS j, covar_samp(a.r, b.r) * 252 AS c FROM rr a JOIN rr b ON a.book = b.book AND a.year = b.year AND a.date = b.date GROUP BY ALL HAVING count(*) > 1),
yy AS (SELECT book, year, i, j, c - CASE WHEN i = j THEN {FLOOR} ELSE 0 END AS v FROM cy),
sg AS (SELECT book, year, i, j, 0 AS k, v / sqrt(sum(v * v) OVER (PARTITION BY book, year)) AS v FROM yy UNION ALL
  SELECT s.book, s.year, s.i, s.j, s.k + 1, 1.5 * s.v - 0.5 * q.v FROM sg s JOIN (SELECT x.book, x.year, x.i, z.j, sum(x.v * y.v * z.v) AS v FROM sg x JOIN sg y ON x.book = y.book AND x.year = y.year AND x.j = y.i JOIN sg z ON y.book = z.book AND y.year = z.year AND y.j = z.i GROUP BY ALL) q ON s.book = q.book AND s.year = q.year AND s.i = q.i AND s.j = q.j WHERE s.k < 60),
fs AS (SELECT * FROM sg WHERE k = 60), ab AS ({mul('yy', 'fs')}),
cl AS (SELECT book, year, i, j, (y.v + ab.v) / 2 + CASE WHEN i = j THEN {FLOOR} ELSE 0 END AS cov FROM yy y JOIN ab USING (book, year, i, j)),
nc AS (SELECT book, year, CAST(round((count(*) - sum(v)) / 2) AS BIGINT) AS n_clipped FROM fs WHERE i = j GROUP BY 1, 2)"""


@query("covariance_clipped", f"WITH RECURSIVE {CLIPPED} SELECT book, year, i AS ticker_i, j AS ticker_j, {r8('cov', 'cov')}, n_clipped FROM cl JOIN nc USING (book, year)")
def _(spark, sf):
    """Each book's covariance of each year, over the dates on which all its tickers have a price."""
    own = T.price_panel(spark, sf).join(books(spark).select("book", "ticker"), "ticker").withColumn("year", F.year("date").cast("long"))
    return C.annualized_covariances(R.on_whole_dates(own, BOOK_YEAR), BOOK_YEAR, 252, FLOOR)


# models by book and month; each is edited by moving a point of weight from its largest ticker to its smallest
MODEL_BY = ("pf_name", "trade_date")
EDITS = WEIGHTS + """,
ed AS (SELECT pf_name, trade_date, first(ticker ORDER BY weight DESC, ticker DESC) AS src, first(ticker ORDER BY weight, ticker) AS dst FROM pw GROUP BY 1, 2 HAVING max(weight) >= 0.01),
ol AS (SELECT pf_name, trade_date, ticker, weight FROM pw SEMI JOIN ed USING (pf_name, trade_date)),
nw AS (SELECT pf_name, trade_date, ticker, weight - CASE WHEN ticker = src THEN 0.01 ELSE 0 END + CASE WHEN ticker = dst THEN 0.01 ELSE 0 END AS weight, '1+' || src || '->' || dst AS version FROM pw JOIN ed USING (pf_name, trade_date))"""


def monthly_models(spark, sf):
    """(models, edits)"""
    m = T.portfolio_weights(spark, sf).select(*MODEL_BY, F.lit("1").alias("version"), "ticker", "weight")
    largest, smallest = F.max_by("ticker", F.struct("weight", "ticker")), F.min_by("ticker", F.struct("weight", "ticker"))
    e = m.groupBy(*MODEL_BY).agg(F.concat_ws(":", largest, smallest, F.lit("0.01")).alias("edit"), F.max("weight").alias("most")).where("most >= 0.01").drop("most")
    return m, e


@query("model_edits", f"WITH {EDITS} SELECT pf_name, trade_date, version, ticker, {r8('weight', 'weight')} FROM nw WHERE weight > 0")
def _(spark, sf):
    return D.apply_edits(*monthly_models(spark, sf), MODEL_BY)


@query("model_problems", f"""WITH {WEIGHTS}, bent AS (SELECT pf_name, trade_date, ticker, CASE WHEN month(trade_date) = 3 AND weight < 0.17 THEN -weight WHEN month(trade_date) = 4 THEN 2 * weight ELSE weight END AS weight FROM pw)
SELECT pf_name, trade_date, CASE WHEN min(weight) < 0 THEN 'negative or non-finite weights: ' || string_agg(ticker, ', ' ORDER BY ticker) FILTER (WHERE weight < 0) ELSE 'weights sum to' END AS reason FROM bent GROUP BY 1, 2 HAVING min(weight) < 0 OR abs(sum(weight) - 1) > 1e-9""")
def _(spark, sf):
    m, month = monthly_models(spark, sf)[0], F.month("trade_date")
    bent = m.withColumn("weight", F.when((month == 3) & (F.col("weight") < 0.17), -F.col("weight")).when(month == 4, 2 * F.col("weight")).otherwise(F.col("weight")))
    return D.problems(bent, by=MODEL_BY).withColumn("reason", F.regexp_replace("reason", "^weights sum to .*", "weights sum to"))


@query("model_change_summary", f"""WITH {COV}, {EDITS}, bn AS (SELECT trade_date, ticker, weight FROM pw WHERE pf_name = 'BUILDING'),
ks AS (SELECT pf_name, trade_date, ticker FROM ol UNION SELECT pf_name, trade_date, ticker FROM nw UNION SELECT pf_name, trade_date, bn.ticker FROM ed JOIN bn USING (trade_date)),
dd AS (SELECT pf_name, trade_date, ticker, coalesce(n.weight, 0) - coalesce(o.weight, 0) AS c, coalesce(o.weight, 0) - coalesce(b.weight, 0) AS ob, coalesce(n.weight, 0) - coalesce(b.weight, 0) AS nb FROM ks LEFT JOIN ol o USING (pf_name, trade_date, ticker) LEFT JOIN nw n USING (pf_name, trade_date, ticker) LEFT JOIN bn b USING (trade_date, ticker)),
te AS (SELECT x.pf_name, x.trade_date, {', '.join(f'1e4 * sqrt(greatest(sum(x.{c} * cov * y.{c}), 0)) AS {c}' for c in ('c', 'ob', 'nb'))} FROM dd x JOIN dd y USING (pf_name, trade_date) JOIN cv ON cv.ticker_i = x.ticker AND cv.ticker_j = y.ticker GROUP BY 1, 2)
SELECT pf_name, trade_date, {r8('sum(abs(dd.c)) / 2', 'turnover')}, count(*) FILTER (WHERE abs(dd.c) > 0.0005) AS n_changed, {r8('any_value(te.c)', 'te_old_new')}, {', '.join(f"round(CASE WHEN trade_date IN (SELECT trade_date FROM bn) THEN any_value(te.{c}) END, 8) AS te_{n}_bench" for c, n in (('ob', 'old'), ('nb', 'new')))} FROM dd JOIN te USING (pf_name, trade_date) GROUP BY 1, 2""")
def _(spark, sf):
    """Tracking errors in basis points, against the month's BUILDING book."""
    m, e = monthly_models(spark, sf)
    bench = m.where("pf_name = 'BUILDING'").select("trade_date", "ticker", "weight").join(e.select(*MODEL_BY), "trade_date")
    s = D.change_summary(m.join(e, list(MODEL_BY), "left_semi"), D.apply_edits(m, e, MODEL_BY), covariance(spark, sf), bench, MODEL_BY)
    return s.withColumns({c: F.col(c) * 1e4 for c in s.columns if c.startswith("te_")})


@query("model_change_by_sleeve", f"""WITH {EDITS}, s AS (SELECT * FROM {values(SLEEVES, 'ticker, sleeve')}), al AS (SELECT pf_name, trade_date, ticker, -weight AS w FROM ol UNION ALL SELECT pf_name, trade_date, ticker, weight FROM nw)
SELECT pf_name, trade_date, sleeve, {r8('sum(w)', 'diff')}, {r8('sum(w) * 1000', 'flow')} FROM al JOIN s USING (ticker) GROUP BY 1, 2, 3""")
def _(spark, sf):
    m, e = monthly_models(spark, sf)
    return D.change_by_sleeve(m.join(e, list(MODEL_BY), "left_semi"), D.apply_edits(m, e, MODEL_BY), literal(spark, SLEEVES, "ticker string, sleeve string"), 1000.0, MODEL_BY)


@query("min_variance")
def _(spark, sf):
    return C.optimise(covariance(spark, sf, 252.0).withColumn("book", F.lit("all")), bound=0.4)


# --- rebalancing --------------------------------------------------------------------------------------------------

BOOK = PANEL + f""",
{MODELS_SQL},
px AS (SELECT ticker, price FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
acc AS (SELECT c_custkey AS account_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'GROWTH' WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'INCOME' ELSE 'UNLISTED' END AS model_id, c_acctbal AS cash FROM customer),
hold AS (SELECT o_custkey AS account_id, p_type AS ticker, SUM(CAST(l_quantity AS DOUBLE)) AS shares FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bad AS (SELECT account_id, bool_or(shares < 0 OR shares <> floor(shares)) AS bad, bool_or(shares <> 0 AND px.ticker IS NULL) AS unpriced FROM hold LEFT JOIN px USING (ticker) GROUP BY 1),
val AS (SELECT a.account_id, a.model_id, a.cash, CASE WHEN a.model_id NOT IN (SELECT model_id FROM models) THEN 'UNKNOWN_MODEL' WHEN a.cash IS NULL OR a.cash < 0 OR coalesce(b.bad, false) THEN 'BAD_HOLDINGS' WHEN coalesce(b.unpriced, false) THEN 'PRICE_MISSING' END AS reason FROM acc a LEFT JOIN bad b USING (account_id))"""
DRIFT = BOOK + """,
ok AS (SELECT * FROM val WHERE reason IS NULL),
tgt AS (SELECT account_id, ticker, weight * 0.98 AS target FROM ok JOIN models USING (model_id)),
pos AS (SELECT coalesce(h.account_id, t.account_id) AS account_id, coalesce(h.ticker, t.ticker) AS ticker, coalesce(h.shares, 0) AS held, coalesce(t.target, 0) AS target FROM (SELECT * FROM hold SEMI JOIN ok USING (account_id) WHERE shares <> 0) h FULL JOIN tgt t ON h.account_id = t.account_id AND h.ticker = t.ticker),
pp AS (SELECT pos.*, px.price FROM pos JOIN px USING (ticker)),
tot AS (SELECT account_id, ok.cash + list_reduce(list_prepend(0.0, list(held * price ORDER BY ticker)), lambda a, x: a + x) AS total_value FROM pp JOIN ok USING (account_id) GROUP BY account_id, ok.cash),
dr AS (SELECT account_id, max(abs(held * price / total_value - target)) AS drift FROM pp JOIN tot USING (account_id) GROUP BY account_id)"""


def fold(items: str) -> str:
    """Sum of a list in its order."""
    return f"list_reduce(list_prepend(0.0, {items}), lambda a, x: a + x)"


RAW = DRIFT + """,
want AS (SELECT pp.account_id, ticker, held, price, target, total_value, CASE WHEN target = 0 THEN -held WHEN (target * total_value - held * price) / price > 0 THEN floor((target * total_value - held * price) / price + 1e-9) ELSE ceil((target * total_value - held * price) / price - 1e-9) END AS cap FROM pp JOIN tot USING (account_id) JOIN dr USING (account_id) WHERE drift > 0.05)"""
SCALED = RAW + """,
cs AS (SELECT account_id, total_value, list_reduce(list_prepend(0.0, list(CASE WHEN cap < 0 THEN cap * price ELSE 0 END ORDER BY ticker)), lambda a, x: a + x) AS s, list_reduce(list_prepend(0.0, list(CASE WHEN cap > 0 THEN cap * price ELSE 0 END ORDER BY ticker)), lambda a, x: a + x) AS buys FROM want GROUP BY account_id, total_value),
av AS (SELECT cs.account_id, buys, ok.cash - s - total_value * 0.02 AS available FROM cs JOIN ok USING (account_id)),
scaled AS (SELECT w.account_id, ticker, w.price, cap, CASE WHEN buys > available AND buys > 0 AND cap > 0 THEN floor(cap * (greatest(available, 0) / buys)) ELSE cap END AS trade, buys > available AND buys > 0 AS cash_short FROM want w JOIN av USING (account_id))"""


def book(spark, sf):
    return T.accounts(spark, sf), T.holdings(spark, sf), models(spark), last_prices(spark, sf)


def valid_book(spark, sf):
    a, h, m, p = book(spark, sf)
    return M.validate(a, h, m, p).where("reason is null"), h, m, p


def valued(spark, sf):
    return M.drift_band(M.valid_positions(*book(spark, sf)))


@query("validate_accounts", f"WITH {BOOK} SELECT account_id, model_id, {r8('cash', 'cash')}, reason FROM val")
def _(spark, sf):
    return M.validate(*book(spark, sf)).select("account_id", "model_id", "cash", "reason")


@query("drift_band", f"WITH {DRIFT} SELECT account_id, {r8('total_value', 'total_value')}, {r8('drift', 'drift_before')}, drift <= 0.05 AS in_band FROM dr JOIN tot USING (account_id)")
def _(spark, sf):
    return valued(spark, sf).select("account_id", "total_value", "drift_before", "in_band")


@query("raw_orders", f"WITH {RAW} SELECT account_id, ticker, {r8('price', 'price')}, CAST(cap AS BIGINT) AS shares FROM want WHERE cap <> 0")
def _(spark, sf):
    rows = M.exploded(M.raw_orders(valued(spark, sf)), "account_id")
    return rows.select("account_id", "x.ticker", "x.price", F.col("x.cap").cast("long").alias("shares")).where("shares <> 0")


@query("cash_scaled_orders", f"WITH {SCALED} SELECT account_id, ticker, cash_short, CAST(trade AS BIGINT) AS shares FROM scaled WHERE trade <> 0")
def _(spark, sf):
    rows = M.exploded(M.cash_scaled(M.raw_orders(valued(spark, sf))), "account_id", "cash_short")
    return rows.select("account_id", "x.ticker", "cash_short", F.col("x.trade").cast("long").alias("shares")).where("shares <> 0")


TOPPED = SCALED + """,
st0 AS (SELECT s.account_id, w.total_value, av.available, list(struct_pack(ticker := s.ticker, held := w.held, price := s.price, target := w.target, cap := s.cap, trade := s.trade) ORDER BY s.ticker) AS o FROM scaled s JOIN want w USING (account_id, ticker) JOIN av USING (account_id) WHERE s.cash_short GROUP BY 1, 2, 3),
tu AS (SELECT account_id, total_value, 0 AS step, available - """ + fold("list_transform(o, lambda x: CASE WHEN x.trade > 0 THEN x.trade * x.price ELSE 0.0 END)") + """ AS l, o FROM st0
 UNION ALL SELECT account_id, total_value, step + 1, l - o[best].price, list_transform(o, lambda x, i: struct_pack(ticker := x.ticker, held := x.held, price := x.price, target := x.target, cap := x.cap, trade := x.trade + CASE WHEN i = best THEN 1.0 ELSE 0.0 END))
 FROM (SELECT *, list_position(gaps, list_max(gaps)) AS best FROM (SELECT *, list_transform(o, lambda x: CASE WHEN x.trade < x.cap AND x.price <= l THEN x.target * total_value - (x.held + x.trade) * x.price END) AS gaps FROM tu) WHERE list_max(gaps) IS NOT NULL)),
fin AS (SELECT account_id, x.ticker AS ticker, x.held AS held, x.price AS price, x.target AS target, x.trade AS trade FROM (SELECT account_id, unnest(o) AS x FROM (SELECT * FROM tu QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY step DESC) = 1))
 UNION ALL SELECT account_id, ticker, held, price, target, cap FROM want SEMI JOIN (SELECT account_id FROM scaled WHERE NOT cash_short) USING (account_id)),
sp AS (SELECT account_id, """ + fold("list(trade * price ORDER BY ticker)") + " AS spent, " + fold("list(abs(trade * price) ORDER BY ticker)") + " AS moved, " + fold("list((held + trade) * price ORDER BY ticker)") + """ AS after, count(*) FILTER (WHERE trade <> 0) AS n_orders FROM fin GROUP BY 1),
da AS (SELECT account_id, max(abs((held + trade) * price / (ok.cash - spent + after) - target)) AS drift_after FROM fin JOIN sp USING (account_id) JOIN ok USING (account_id) GROUP BY 1),
short AS (SELECT account_id, bool_or(cash_short) AS cash_short FROM scaled GROUP BY 1),
done AS (SELECT ok.account_id, ok.model_id, total_value, drift AS drift_before, coalesce(drift_after, drift) AS drift_after, coalesce(moved / 2 / total_value, 0.0) AS turnover, ok.cash - coalesce(spent, 0) AS post_cash, coalesce(n_orders, 0) AS n_orders, coalesce(cash_short, false) AS cash_short,
 CASE WHEN sp.account_id IS NULL THEN 'SKIPPED_IN_BAND' WHEN n_orders > 0 THEN 'TRADED' ELSE 'EXC_TOO_SMALL' END AS status
 FROM ok JOIN tot USING (account_id) JOIN dr USING (account_id) LEFT JOIN sp USING (account_id) LEFT JOIN da USING (account_id) LEFT JOIN short USING (account_id))"""


@query("rebalance_orders", f"WITH RECURSIVE {TOPPED} SELECT account_id, ticker, {r8('trade', 'shares')}, CASE WHEN trade > 0 THEN 'BUY' ELSE 'SELL' END AS side, {r8('price', 'price')}, {r8('trade * price', 'notional')} FROM fin WHERE trade <> 0")
def _(spark, sf):
    return M.orders_of(M.rebalanced(M.valid_positions(*book(spark, sf))))


@query("rebalance_accounts", f"""WITH RECURSIVE {TOPPED} SELECT val.account_id, val.model_id, coalesce(status, 'EXC_INPUT') AS status, reason, CASE WHEN status IS NULL THEN NULL WHEN status = 'SKIPPED_IN_BAND' THEN '' ELSE concat_ws(';', CASE WHEN cash_short THEN 'CASH_SHORT' END, CASE WHEN drift_after > 0.05 THEN 'STILL_OUT_OF_BAND' END) END AS flags,
{r8('total_value', 'total_value')}, {r8('drift_before', 'drift_before')}, {r8('drift_after', 'drift_after')}, {r8('turnover', 'turnover')}, {r8('post_cash', 'post_cash')}, n_orders FROM val LEFT JOIN done USING (account_id)""")
def _(spark, sf):
    r = M.run(*book(spark, sf), most_excluded=1.0)
    return r.select("account_id", "model_id", "status", "reason", F.array_join("flags", ";").alias("flags"), "total_value", "drift_before", "drift_after", "turnover", "post_cash", "n_orders")


COUNTS_SQL = "count(*) AS target, count(*) FILTER (WHERE status = 'TRADED') AS processed, count(*) FILTER (WHERE status = 'EXC_TOO_SMALL' OR reason IS NOT NULL) AS exceptions, count(*) FILTER (WHERE status = 'SKIPPED_IN_BAND') AS skipped"


@query("run_reconcile", f"WITH RECURSIVE {TOPPED}, n AS (SELECT {COUNTS_SQL} FROM val LEFT JOIN done USING (account_id)) SELECT *, target = processed + exceptions + skipped AS reconciled FROM n")
def _(spark, sf):
    return M.reconcile(M.run(*book(spark, sf), most_excluded=1.0))


@query("run_summary", f"WITH RECURSIVE {TOPPED}, n AS (SELECT {COUNTS_SQL} FROM val LEFT JOIN done USING (account_id)) SELECT CASE WHEN target = processed + exceptions + skipped THEN 'OK' ELSE 'FAILED_RECONCILIATION' END AS status, CAST(NULL AS VARCHAR) AS abort_reason, target, processed, exceptions, skipped FROM n")
def _(spark, sf):
    return M.run_summary(*book(spark, sf), most_excluded=1.0)


SIZED = "CASE WHEN total_value <= 0 OR total_value IS NULL THEN NULL WHEN total_value <= 25000 THEN '<=25k' WHEN total_value <= 100000 THEN '25k-100k' WHEN total_value <= 500000 THEN '100k-500k' ELSE '>500k' END"


@query("run_report", f"""WITH RECURSIVE {TOPPED}, ev AS (SELECT val.model_id, coalesce(status, 'EXC_INPUT') AS status, {SIZED} AS size, total_value AS v, turnover AS tu_, n_orders AS k, coalesce(cash_short, false) AS cs_, status IN ('TRADED', 'EXC_TOO_SMALL') AND drift_after > 0.05 AS out_ FROM val LEFT JOIN done USING (account_id))
SELECT status, model_id, size, grouping(status, model_id, size) AS level, count(*) AS accounts, {', '.join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (('traded', "status = 'TRADED'"), ('in_band', "status = 'SKIPPED_IN_BAND'"), ('too_small', "status = 'EXC_TOO_SMALL'"), ('failed', "status = 'EXC_INPUT'"), ('cash_short', 'cs_'), ('still_out', 'out_')))},
CAST(coalesce(sum(k) FILTER (WHERE status = 'TRADED'), 0) AS BIGINT) AS orders, round(coalesce(sum(2 * tu_ * v) FILTER (WHERE status = 'TRADED'), 0), 4) AS gross_notional, round(coalesce(sum(v), 0), 4) AS book_value, {r8("coalesce(sum(tu_ * v) FILTER (WHERE status = 'TRADED') / nullif(sum(v), 0), 0)", 'book_turnover')}
FROM ev GROUP BY GROUPING SETS ((), (status), (model_id), (size), (status, model_id), (model_id, size))""")
def _(spark, sf):
    return M.run_report(M.run(*book(spark, sf), most_excluded=1.0)).withColumns({c: F.round(c, 4) for c in ("gross_notional", "book_value")})


@query("run_aborted", f"WITH {BOOK} SELECT 'ABORTED' AS status, 'ABORTED_TOO_MANY_EXCLUDED: ' || count(reason) || '/' || count(*) AS abort_reason, count(*) AS target, CAST(0 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS exceptions, CAST(0 AS BIGINT) AS skipped FROM val")
def _(spark, sf):
    """At the limit of 5 % the accounts of a model that is not listed abort the run."""
    return M.run_summary(*book(spark, sf)).fillna(0, ["processed", "exceptions", "skipped"])


@query("account_detail", f"""WITH RECURSIVE {TOPPED}, every AS (SELECT account_id, ticker, held, price, target, trade FROM fin UNION ALL SELECT account_id, ticker, held, price, target, 0.0 FROM pp ANTI JOIN sp USING (account_id)),
rw AS (SELECT account_id, ticker, price, held AS b, trade AS t, held + trade AS a, target FROM every UNION ALL SELECT account_id, 'CASH', 1.0, ok.cash, post_cash - ok.cash, post_cash, 0.02 FROM done JOIN ok USING (account_id))
SELECT account_id, ticker, {r8('price', 'price')}, {r8('b', 'shares_before')}, {r8('t', '"order"')}, {r8('a', 'shares_after')}, {r8('target', 'target')}, {r8('b * price / total_value', 'weight_before')}, {r8('a * price / total_value', 'weight_after')}, {r8('b * price / total_value - target', 'drift_before')}, {r8('a * price / total_value - target', 'drift_after')} FROM rw JOIN tot USING (account_id)""")
def _(spark, sf):
    return M.account_detail(M.rebalanced(M.valid_positions(*book(spark, sf))))


@query("rerun_noop", f"""WITH RECURSIVE {TOPPED}, again AS (SELECT f.account_id, max(abs((held + trade) * price / (ok.cash - spent + after) - target)) AS drift FROM (SELECT account_id, ticker, held, price, target, trade FROM fin UNION ALL SELECT account_id, ticker, held, price, target, 0.0 FROM pp ANTI JOIN sp USING (account_id)) f
JOIN ok USING (account_id) LEFT JOIN (SELECT account_id, spent, after FROM sp UNION ALL SELECT account_id, 0.0, {fold('list(held * price ORDER BY ticker)')} FROM pp ANTI JOIN sp USING (account_id) GROUP BY 1) USING (account_id) GROUP BY 1)
SELECT count(*) AS accounts, count(*) FILTER (WHERE drift <= 0.05) AS skipped FROM again""")
def _(spark, sf):
    """A second run on what the first one left: how many accounts are within their band now."""
    again = M.drift_band(M.positions_after(M.rebalanced(M.valid_positions(*book(spark, sf)))))
    return again.agg(F.count("*").alias("accounts"), F.sum(F.col("in_band").cast("long")).alias("skipped"))


BANDS = (0.01, 0.02, 0.03, 0.05)


@query("band_table", " UNION ALL ".join(f"(WITH RECURSIVE {TOPPED.replace('drift > 0.05', f'drift > {b}')} SELECT CAST({b} AS DOUBLE) AS band, count(*) AS accounts, count(*) FILTER (WHERE status IN ('TRADED', 'EXC_TOO_SMALL')) AS triggered, count(*) FILTER (WHERE status = 'TRADED') AS traded, count(*) FILTER (WHERE status = 'EXC_TOO_SMALL') AS too_small, CAST(coalesce(sum(n_orders) FILTER (WHERE status = 'TRADED'), 0) AS BIGINT) AS orders, {r8("coalesce(sum(turnover * total_value) FILTER (WHERE status = 'TRADED'), 0) / sum(total_value)", 'book_turnover')}, {r8("coalesce(quantile_cont(drift_after, 0.5) FILTER (WHERE status = 'TRADED'), 0)", 'median_drift')} FROM done)" for b in BANDS))
def _(spark, sf):
    return M.by_band(M.valid_positions(*book(spark, sf)), BANDS)


# --- attribution --------------------------------------------------------------------------------------------------

BRINSON = GRID + f""", {MODELS_SQL}, sl AS (SELECT * FROM {values(SLEEVES, 'ticker, sleeve')}), g AS (SELECT ticker, arg_max(price, date) / arg_min(price, date) AS growth FROM panel GROUP BY ticker),
side AS (SELECT model_id, sleeve, sum(weight) AS w, sum(weight * (growth - 1)) / sum(weight) AS r FROM models JOIN g USING (ticker) JOIN sl USING (ticker) GROUP BY 1, 2),
two AS (SELECT sleeve, coalesce(p.w, 0) AS wp, coalesce(b.w, 0) AS wb, coalesce(p.r, b.r) AS rp, coalesce(b.r, p.r) AS rb FROM (SELECT * FROM side WHERE model_id = 'GROWTH') p FULL JOIN (SELECT * FROM side WHERE model_id = 'INCOME') b USING (sleeve)),
al AS (SELECT *, (SELECT sum(w * r) FROM side WHERE model_id = 'INCOME') AS total FROM two)"""


def growths(spark, sf):
    return T.price_panel(spark, sf).groupBy("ticker").agg((F.max_by("price", "date") / F.min_by("price", "date")).alias("growth"))


@query("brinson", f"WITH {BRINSON} SELECT sleeve, {r8('(wp - wb) * (rb - total)', 'allocation')}, {r8('wb * (rp - rb)', 'selection')}, {r8('(wp - wb) * (rp - rb)', 'interaction')} FROM al")
def _(spark, sf):
    g, s = growths(spark, sf), literal(spark, SLEEVES, "ticker string, sleeve string")
    return A.brinson(A.sleeves(one_model(spark, "GROWTH"), g, s), A.sleeves(one_model(spark, "INCOME"), g, s))


END_SQL = "(SELECT max(date) FROM ret)"
IMPL = GRID.replace("ret AS (", "ret AS (", 1) + f""", {BOOK.split(PANEL + ',', 1)[1]},
days AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM ret)),
st AS (SELECT v.account_id, v.model_id, v.cash, d.date AS start FROM val v JOIN days d ON d.back = 22 + v.account_id % 60 WHERE v.reason IS NULL),
full_px AS (SELECT ticker, date, price FROM padded WHERE price IS NOT NULL),
gr AS (SELECT a.ticker, a.date AS start, a.price AS p0, b.price / a.price AS growth FROM full_px a JOIN full_px b ON a.ticker = b.ticker AND b.date = {END_SQL}),
md AS (SELECT m.model_id, r.date, sum(m.weight * r.r) AS r FROM ret r JOIN models m USING (ticker) GROUP BY 1, 2),
sp AS (SELECT DISTINCT model_id, start FROM st),
mr AS (SELECT sp.model_id, sp.start, product(1 + md.r) - 1 AS mr FROM sp JOIN md ON md.model_id = sp.model_id AND md.date > sp.start AND md.date <= {END_SQL} GROUP BY 1, 2),
bh AS (SELECT sp.model_id, sp.start, sum(m.weight * gr.growth) - 1 AS bh FROM sp JOIN models m USING (model_id) JOIN gr ON gr.ticker = m.ticker AND gr.start = sp.start GROUP BY 1, 2),
ow AS (SELECT st.account_id, sum(h.shares * gr.p0) AS h0, sum(h.shares * gr.p0 * gr.growth) AS h1 FROM st JOIN hold h USING (account_id) JOIN gr ON gr.ticker = h.ticker AND gr.start = st.start WHERE h.shares <> 0 GROUP BY 1),
im0 AS (SELECT st.account_id, st.model_id, st.start, st.cash, coalesce(h0, 0) AS h0, coalesce(h1, 0) AS h1, mr, bh, coalesce(h0, 0) + st.cash AS v0 FROM st JOIN mr USING (model_id, start) JOIN bh USING (model_id, start) LEFT JOIN ow USING (account_id)),
im AS (SELECT *, (h1 + cash) / v0 - 1 AS acct, cash / v0 AS c0, coalesce(h1 / nullif(h0, 0) - 1, 0) AS inv FROM im0 WHERE v0 <> 0)"""


def started_book(spark, sf):
    """Valid accounts with a day of their last rebalance, their holdings and models."""
    from pyspark.sql import Window

    a, h, m, _ = valid_book(spark, sf)
    days = R.simple_returns(T.price_panel(spark, sf)).select("date").distinct().withColumn("back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))))  # trading days: a few thousand
    return a.join(days, F.col("back") == 22 + F.col("account_id") % 60).select("account_id", "model_id", "cash", F.col("date").alias("last_rebalanced")), h, m


def padded_to_end(spark, sf):
    """Prices of every ticker on every day, and the last day."""
    panel = T.price_panel(spark, sf)
    end = R.simple_returns(panel).agg(F.max("date")).first()[0]
    return R.padded(panel).where("price is not null"), end


def effects(spark, sf):
    return A.implementation_effects(*started_book(spark, sf), *padded_to_end(spark, sf))


@query("implementation_effect", f"WITH {IMPL} SELECT account_id, model_id, start, {r8('v0', 'value_start')}, {r8('c0', 'cash_start')}, {r8('mr', 'model_rebalanced')}, {r8('bh', 'model_buy_hold')}, {r8('acct', 'account')}, {r8('bh - mr', 'drift_effect')}, {r8('-c0 * bh', 'cash_effect')}, {r8('(1 - c0) * (inv - bh)', 'rounding_effect')}, {r8('acct - mr', 'total')} FROM im")
def _(spark, sf):
    return effects(spark, sf)


ATTRIBUTION = IMPL + f""",
bm AS (SELECT CASE WHEN model_id = 'GROWTH' THEN 'INCOME' ELSE 'GROWTH' END AS model_id, ticker, weight FROM models), sl AS (SELECT * FROM {values(SLEEVES, 'ticker, sleeve')}),
ps AS (SELECT sp.model_id, sp.start, sleeve, sum(weight) AS w, sum(weight * (growth - 1)) / sum(weight) AS r FROM sp JOIN models m ON m.model_id = sp.model_id JOIN gr ON gr.ticker = m.ticker AND gr.start = sp.start JOIN sl ON sl.ticker = m.ticker GROUP BY 1, 2, 3),
bs AS (SELECT sp.model_id, sp.start, sleeve, sum(weight) AS w, sum(weight * (growth - 1)) / sum(weight) AS r FROM sp JOIN bm m ON m.model_id = sp.model_id JOIN gr ON gr.ticker = m.ticker AND gr.start = sp.start JOIN sl ON sl.ticker = m.ticker GROUP BY 1, 2, 3),
bt AS (SELECT model_id, start, sum(w * r) AS total FROM bs GROUP BY 1, 2),
br AS (SELECT model_id, start, sum((p.w - b.w) * (b.r - total)) AS al, sum(b.w * (p.r - b.r)) AS se, sum((p.w - b.w) * (p.r - b.r)) AS it FROM ps p JOIN bs b USING (model_id, start, sleeve) JOIN bt USING (model_id, start) GROUP BY 1, 2)"""


@query("attribution_table", f"""WITH {ATTRIBUTION} SELECT account_id, model_id, start, {r8('total', 'benchmark')}, {r8('bh', 'model')}, {r8('acct', 'account')}, {r8('al', 'allocation')}, {r8('se', 'selection')}, {r8('it', 'interaction')}, {r8('-c0 * bh', 'cash')}, {r8('(1 - c0) * (inv - bh)', 'rounding')}, {r8('bh - mr', 'drift')}, {r8('acct - total', 'active')}
FROM im JOIN bt USING (model_id, start) JOIN br USING (model_id, start)""")
def _(spark, sf):
    """Each of the two models is the other one's benchmark."""
    benchmarks = models(spark).withColumn("model_id", F.when(F.col("model_id") == "GROWTH", "INCOME").otherwise("GROWTH"))
    return A.attribution_table(*started_book(spark, sf), benchmarks, *padded_to_end(spark, sf), literal(spark, SLEEVES, "ticker string, sleeve string"))


@query("size_buckets", f"WITH {IMPL} SELECT CASE WHEN v0 <= 25000 THEN '<=25k' WHEN v0 <= 100000 THEN '25k-100k' WHEN v0 <= 500000 THEN '100k-500k' ELSE '>500k' END AS size, count(*) AS n, {r8('quantile_cont(c0, 0.5)', 'cash_start')}, {r8('quantile_cont(bh - mr, 0.5) * 1e4', 'drift_bp')}, {r8('quantile_cont(-c0 * bh, 0.5) * 1e4', 'cash_bp')}, {r8('quantile_cont((1 - c0) * (inv - bh), 0.5) * 1e4', 'rounding_bp')}, {r8('quantile_cont(acct - mr, 0.5) * 1e4', 'median_bp')}, {r8('min(acct - mr) * 1e4', 'min_bp')} FROM im WHERE v0 > 0 GROUP BY 1")
def _(spark, sf):
    return A.by_size(effects(spark, sf))


@query("model_medians", f"WITH {IMPL} SELECT model_id, {r8('quantile_cont(acct - mr, 0.5) * 1e4', 'median_bp')}, count(*) AS n FROM im GROUP BY 1")
def _(spark, sf):
    return A.by_model(effects(spark, sf))
