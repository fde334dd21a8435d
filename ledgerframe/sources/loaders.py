"""Loaders of the securities store: prices, weights, factor model, regime scores (any DataFrame will do)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Physical columns of the price fields, and the instrument types left out by default (fixed values).
PRICE_COLUMNS = {"adj_close": "adj_close_price", "close": "close_price"}
EXCLUDED_TYPES = ("factor", "index", "mutualfund")


def price_column(field: str) -> str:
    if field not in PRICE_COLUMNS:
        raise ValueError(f"unknown price field {field!r}: one of {sorted(PRICE_COLUMNS)}")
    return PRICE_COLUMNS[field]


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) in a full order, never an arbitrary one."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in cols]))
    return rows.withColumn("_nr", nr).where("_nr = 1").drop("_nr")


def get_prices(prices: DataFrame, calendar: DataFrame, tickers: Sequence[str], start, end, field: str = "adj_close", exclude_types: Sequence[str] = EXCLUDED_TYPES) -> DataFrame:
    """ticker, date, price on trading days within [start, end]; positive prices, last duplicate wins."""
    if not tickers:
        raise ValueError("no tickers")
    column = price_column(field)
    day = F.to_date("price_date")
    rows = prices.where(F.col("ticker").isin(list(tickers)) & day.between(F.lit(start), F.lit(end)) & (F.col(column) > 0))
    if exclude_types:
        rows = rows.where(F.col("instrument_type").isNull() | ~F.col("instrument_type").isin(list(exclude_types)))
    trading = calendar.where("is_trading_day = 1").select(F.col("cal_date").alias("date"))
    rows = rows.withColumn("date", day).join(trading, "date", "left_semi")
    return keep_last(rows, ["ticker", "date"], ["price_date", column]).select("ticker", "date", F.col(column).alias("price"))


def to_wide(prices: DataFrame, tickers: Sequence[str], value: str = "price", order: Sequence[str] = ()) -> DataFrame:
    """date and one column for each ticker, by date. Of rows for one ticker and date the last in `order` stands; without an order they are an error."""
    if order:
        cell = F.max_by(value, F.struct(*order))
    else:
        cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("rows for one ticker and date need an order"))).otherwise(F.max(value))
    return prices.groupBy("date").pivot("ticker", list(tickers)).agg(cell).orderBy("date")


def list_portfolios(weights: DataFrame) -> DataFrame:
    keys = ["pf_name", "experiment_id", "branch", "source"]
    return weights.groupBy(*keys).agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.countDistinct("trade_date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"))


def weights_asof(weights: DataFrame, asof, pf_name: str | None = None, experiment_id: str | None = None, branch: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of the last snapshot on or before asof: of one book (keys match null-safely), or of every book."""
    keys = ["pf_name", "experiment_id", "branch", "source"]
    rows = weights.where(F.col("trade_date") <= F.lit(asof))
    if pf_name is not None:
        for key, value in zip(keys, (pf_name, experiment_id, branch, source)):
            rows = rows.where(F.col(key).eqNullSafe(F.lit(value)))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("trade_date")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def mirror_factor_cov(triangle: DataFrame) -> DataFrame:
    """Full factor_i, factor_j, cov of a stored triangle; pairs that are not stored are 0."""
    stored = triangle.select("factor_i", "factor_j", "cov")
    both = stored.union(stored.where("factor_i <> factor_j").select("factor_j", "factor_i", "cov"))
    names = both.select(F.col("factor_i").alias("f")).distinct()
    grid = names.select(F.col("f").alias("factor_i")).crossJoin(names.select(F.col("f").alias("factor_j")))  # factors x factors, both few
    return grid.join(both, ["factor_i", "factor_j"], "left").select("factor_i", "factor_j", F.coalesce("cov", F.lit(0.0)).alias("cov"))


def require_positive_diagonal(cov: DataFrame) -> None:
    bad = cov.where("factor_i = factor_j and cov <= 0").select("factor_i").limit(5).collect()
    if bad:
        raise ValueError(f"variance is not positive: {[r['factor_i'] for r in bad]}")


def align_factor_model(betas: DataFrame, cov: DataFrame, resid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables over the factors and tickers that all of them know; tickers with a missing beta go."""
    factors = betas.select("factor").distinct().join(cov.select(F.col("factor_i").alias("factor")).distinct(), "factor", "left_semi")
    b = betas.where("beta is not null").join(factors, "factor", "left_semi")
    n = factors.agg(F.count("*").alias("n_factors"))
    whole = b.groupBy("ticker").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).where("n = n_factors").select("ticker")
    whole = whole.join(resid.select("ticker"), "ticker", "left_semi")
    c = cov.join(factors.withColumnRenamed("factor", "factor_i"), "factor_i", "left_semi").join(factors.withColumnRenamed("factor", "factor_j"), "factor_j", "left_semi")
    return b.join(whole, "ticker", "left_semi"), c, resid.join(whole, "ticker", "left_semi")


def regime_history(scores: DataFrame, start, end, score_name: str) -> DataFrame:
    return scores.where(F.col("as_of_date").between(F.lit(start), F.lit(end)) & (F.col("score_name") == score_name)).orderBy("as_of_date")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The rows; LookupError if there is none."""
    if rows.isEmpty():
        raise LookupError(f"no {what}")
    return rows


def factor_betas(table: DataFrame, asof, tickers: Sequence[str], lookback: int, version: str, order: Sequence[str]) -> DataFrame:
    """ticker, factor, beta of one model version as of a date; of rows for one ticker and factor the last in `order`."""
    if not tickers:
        raise ValueError("no tickers given")
    rows = table.where((F.col("asof_date") == F.lit(asof)) & (F.col("lookback") == lookback) & (F.col("version") == version) & F.col("ticker").isin(list(tickers)))
    return keep_last(rows, ["ticker", "factor"], order).select("ticker", "factor", "beta")


def residual_variances(table: DataFrame, asof, tickers: Sequence[str], lookback: int, method: str, order: Sequence[str]) -> DataFrame:
    """ticker, resid_var as of a date; of rows for one ticker the first in `order`."""
    if not tickers:
        raise ValueError("no tickers given")
    rows = table.where((F.col("asof_date") == F.lit(asof)) & (F.col("lookback") == lookback) & (F.col("method") == method) & F.col("ticker").isin(list(tickers)))
    return rows.groupBy("ticker").agg(F.min_by("resid_var", F.struct(*order)).alias("resid_var"))


def factor_covariance(table: DataFrame, asof, lookback: int, version: str, method: str) -> DataFrame:
    """Full factor covariance as of a date; LookupError if there is none."""
    rows = table.where((F.col("asof_date") == F.lit(asof)) & (F.col("lookback") == lookback) & (F.col("version") == version) & (F.col("method") == method))
    cov = mirror_factor_cov(require_rows(rows, f"factor covariance as of {asof}"))
    require_positive_diagonal(cov)
    return cov


def require_assets(resid: DataFrame, least: int = 2) -> None:
    """LookupError if fewer tickers than that are left in an aligned factor model."""
    n = resid.limit(least).count()
    if n < least:
        raise LookupError(f"only {n} tickers are left; {least} are needed")
