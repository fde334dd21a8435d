"""Returns and panels in long form: (key..., ticker, date, price) in, (key..., ticker, date, r) out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.checks import require_known

#: Ratios that a split makes of a price (fixed values).
SPLIT_FACTORS = (2, 3, 4, 5, 6, 8, 10, 20, 50, 100)


def padded(prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The full grid of tickers and dates of each key, gaps filled with the last price before them."""
    keys = list(by)
    tickers, dates = prices.select(*keys, "ticker").distinct(), prices.select(*keys, "date").distinct()
    grid = tickers.join(dates, keys) if keys else tickers.crossJoin(dates)  # the panel itself is this large
    filled = grid.join(prices.select(*keys, "ticker", "date", "price"), [*keys, "ticker", "date"], "left")
    so_far = Window.partitionBy(*keys, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("price", F.last("price", ignorenulls=True).over(so_far))


def simple_returns(prices: DataFrame, by: Sequence[str] = (), dropna: str = "any") -> DataFrame:
    """Change to the row before on the padded grid. dropna: "any" keeps dates with every ticker, "all" drops empty dates."""
    order = Window.partitionBy(*by, "ticker").orderBy("date")
    grid = padded(prices, by)
    return _drop(grid.select(*by, "ticker", "date", (F.col("price") / F.lag("price").over(order) - 1).alias("r")), by, dropna)


def unpadded_returns(prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change to the date before on the grid of each key's tickers and dates, null where either price is missing; the first date has no row."""
    keys = list(by)
    tickers, dates = prices.select(*keys, "ticker").distinct(), prices.select(*keys, "date").distinct()
    grid = (tickers.join(dates, keys) if keys else tickers.crossJoin(dates)).join(prices.select(*keys, "ticker", "date", "price"), [*keys, "ticker", "date"], "left")
    order = Window.partitionBy(*keys, "ticker").orderBy("date")
    rows = grid.withColumn("r", F.col("price") / F.lag("price").over(order) - 1).withColumn("_nr", F.row_number().over(order))
    return rows.where("_nr > 1").select(*keys, "ticker", "date", "r")


def on_whole_dates(prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The prices of dates on which all tickers of their group (by) have one."""
    keys = list(by)
    counted = prices.withColumn("_k", F.count("price").over(Window.partitionBy(*keys, "date")))
    n = prices.groupBy(*keys).agg(F.countDistinct("ticker").alias("_n"))
    return (counted.join(n, keys) if keys else counted.crossJoin(F.broadcast(n))).where("_k = _n").drop("_k", "_n")  # without keys n is one row


def log_returns(prices: DataFrame, by: Sequence[str] = (), dropna: str = "any") -> DataFrame:
    """Differences of logarithms on the unpadded grid: a gap leaves two nulls."""
    keys = list(by)
    tickers, dates = prices.select(*keys, "ticker").distinct(), prices.select(*keys, "date").distinct()
    grid = (tickers.join(dates, keys) if keys else tickers.crossJoin(dates)).join(prices, [*keys, "ticker", "date"], "left")
    order = Window.partitionBy(*by, "ticker").orderBy("date")
    return _drop(grid.select(*by, "ticker", "date", (F.ln("price") - F.lag(F.ln("price")).over(order)).alias("r")), by, dropna)


def _drop(returns: DataFrame, by: Sequence[str], dropna: str) -> DataFrame:
    if dropna not in ("any", "all"):
        raise ValueError(f"dropna: any or all, not {dropna!r}")
    # every ticker has a row on every date of the grid, so the grid itself says how many there are
    date = Window.partitionBy(*by, "date")
    kept = returns.withColumn("_k", F.count("r").over(date)).withColumn("_n", F.count("*").over(date))
    return kept.where("_k = _n" if dropna == "any" else "_k > 0").drop("_k", "_n")


def flag_suspect_moves(returns: DataFrame, tolerance: float = 0.10, extreme: float = 0.75) -> DataFrame:
    """Rows whose move looks like an unadjusted split, or is extreme, with the reason."""
    factors = F.array(*[F.lit(float(f)) for k in SPLIT_FACTORS for f in (k, 1.0 / k)])
    growth = 1 + F.col("r")
    split = F.exists(factors, lambda f: F.abs(growth / f - 1) <= tolerance)
    reason = F.when(split, "split").when(F.abs("r") >= extreme, "extreme")
    return returns.withColumn("reason", reason).where(F.col("reason").isNotNull())


def exposures(weights: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    return weights.groupBy(*by).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))


def book_returns(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """book, date, r: weighted returns of each book's own tickers, dates with all of them only; a ticker without prices is an error."""
    weights = require_known(weights, prices, "ticker", "no prices for")
    own = prices.join(weights.select("book", "ticker"), "ticker")
    r = simple_returns(own, ["book"], "any").join(weights, ["book", "ticker"])
    return r.groupBy("book", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def common_window(book_returns_: DataFrame) -> DataFrame:
    """Rows on the dates that every book has."""
    n = book_returns_.select("book").distinct().agg(F.count("*").alias("n_books"))
    dates = book_returns_.groupBy("date").agg(F.countDistinct("book").alias("n")).crossJoin(F.broadcast(n)).where("n = n_books").select("date")
    return book_returns_.join(dates, "date", "left_semi")


def missing_tickers(requested: DataFrame, prices: DataFrame) -> DataFrame:
    return requested.select("ticker").distinct().join(prices.select("ticker"), "ticker", "left_anti")


def asset_return_lists(returns: DataFrame) -> DataFrame:
    """ticker, dates, r: one row of arrays in date order for each ticker."""
    pairs = F.array_sort(F.collect_list(F.struct("date", "r")))
    return returns.groupBy("ticker").agg(pairs.alias("p")).select("ticker", F.col("p.date").alias("dates"), F.col("p.r").alias("r"))


def market_on_book_dates(book: DataFrame, market: DataFrame) -> DataFrame:
    """book rows with the market's return; cumulative only for books whose market has no gap on their dates."""
    joined = book.join(market.select("date", F.col("r").alias("m")), "date", "left")
    whole = F.bool_and(F.col("m").isNotNull()).over(Window.partitionBy("book"))
    so_far = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("m_cumulative", F.when(whole, F.product(1 + F.col("m")).over(so_far) - 1))
