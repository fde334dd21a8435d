"""Performance statistics of return series: (series..., date, r)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

YEAR = 252


def running(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def cumulative(returns: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """Adds cumulative (running compound return) and drawdown (against a peak of 1 at least)."""
    so_far = running(by)
    wealth = returns.withColumn("_wealth", F.product(1 + F.coalesce("r", F.lit(0.0))).over(so_far))
    peak = F.greatest(F.max("_wealth").over(so_far), F.lit(1.0))
    return wealth.withColumn("cumulative", F.col("_wealth") - 1).withColumn("drawdown", F.col("_wealth") / peak - 1).drop("_wealth")


def performance_stats(returns: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """annual_return, annual_vol, sharpe (null without volatility), total_return, max_drawdown, n.

    The exponent uses all rows, null returns included; product and deviation skip them.
    """
    g = cumulative(returns, by).groupBy(*by).agg(F.product(1 + F.col("r")).alias("growth"), F.stddev_samp("r").alias("sd"), F.min("drawdown").alias("max_drawdown"), F.count("*").alias("n"))
    annual = F.pow("growth", YEAR / F.col("n")) - 1
    vol = F.col("sd") * F.sqrt(F.lit(float(YEAR)))
    return g.select(*by, annual.alias("annual_return"), vol.alias("annual_vol"), F.try_divide(annual, vol).alias("sharpe"), (F.col("growth") - 1).alias("total_return"), "max_drawdown", "n")


def yearly(returns: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    return returns.groupBy(*by, F.year("date").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("r"))


def deepest_drawdown(returns: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    return cumulative(returns, by).groupBy(*by).agg(F.min(F.struct("drawdown", "date")).alias("d")).select(*by, F.col("d.date").alias("date"), F.col("d.drawdown").alias("drawdown"))


def leg_returns(returns: DataFrame, legs: DataFrame) -> DataFrame:
    """position, date, r of LONG and SHORT legs.

    With abs_weight: weights scaled to the tickers that have returns, a missing return counts 0.
    Without: the mean of the returns there are.
    """
    have = legs.join(returns.select("ticker").distinct(), "ticker", "left_semi")
    weighted = "abs_weight" in legs.columns
    if not weighted:
        have = have.withColumn("abs_weight", F.lit(None).cast("double"))
    share = F.col("abs_weight") / F.sum("abs_weight").over(Window.partitionBy("position"))
    r = returns.join(have.withColumn("share", share), "ticker")
    value = F.sum(F.coalesce("r", F.lit(0.0)) * F.col("share")) if weighted else F.avg("r")
    return r.groupBy("position", "date").agg(value.alias("r"))


def long_short(returns: DataFrame, legs: DataFrame) -> DataFrame:
    """date, long, short, spread."""
    leg = leg_returns(returns, legs)
    pick = lambda side: F.max(F.when(F.col("position") == side, F.col("r")))
    return leg.groupBy("date").agg(pick("LONG").alias("long"), pick("SHORT").alias("short")).withColumn("spread", F.col("long") - F.col("short"))


def leg_series(returns: DataFrame, legs: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """series (LONG, SHORT, SPREAD, BENCHMARK), date, r. The spread has the dates of both legs; an empty leg has no rows and leaves no spread.

    The input of `cumulative` and `performance_stats` by series. benchmark: date, r; its rows on the legs' dates are used.
    """
    one = long_short(returns, legs)
    rows = one.select("date", F.explode(F.create_map(F.lit("LONG"), "long", F.lit("SHORT"), "short", F.lit("SPREAD"), "spread")).alias("series", "r")).where("r is not null").select("series", "date", "r")
    if benchmark is None:
        return rows
    return rows.unionByName(benchmark.join(one.select("date"), "date", "left_semi").where("r is not null").select(F.lit("BENCHMARK").alias("series"), "date", "r"))


def turnover(now: DataFrame, before: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-way sum of weight changes over the tickers of either; gross where there is no book before."""
    a = now.select(*by, "ticker", F.col("weight").alias("w"))
    b = before.select(*by, "ticker", F.col("weight").alias("v"))
    both = a.join(b, [*by, "ticker"], "full")
    change = F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))).alias("turnover")
    return both.groupBy(*by).agg(change) if by else both.agg(change)


def rebalance_turnover(weights: DataFrame, by: Sequence[str] = ("pf_name",)) -> DataFrame:
    """turnover at every trade_date against the snapshot before; the first date has its gross."""
    dates = weights.select(*by, "trade_date").distinct().withColumn("next_date", F.lead("trade_date").over(Window.partitionBy(*by).orderBy("trade_date")))
    moved = weights.join(dates, [*by, "trade_date"]).where("next_date is not null").select(*by, F.col("next_date").alias("trade_date"), "ticker", "weight")
    return turnover(weights, moved, [*by, "trade_date"])


def realized_beta(pairs: DataFrame, asset: str = "a", market: str = "m", by: Sequence[str] = ("book",)) -> DataFrame:
    """beta, alpha, r2 (null for a constant asset), n over rows where both are there."""
    both = pairs.where(F.col(asset).isNotNull() & F.col(market).isNotNull())
    r2 = F.when(F.var_pop(asset) > 0, F.regr_r2(F.col(asset), F.col(market)))
    return both.groupBy(*by).agg(F.regr_slope(F.col(asset), F.col(market)).alias("beta"), F.regr_intercept(F.col(asset), F.col(market)).alias("alpha"), r2.alias("r2"), F.count("*").alias("n"))


def rolling_breaches(breaches: DataFrame, alpha: float, window: int = 63, by: Sequence[str] = ("book",)) -> DataFrame:
    """Breaches in the last `window` days and the number expected; null until the window is full."""
    frame = Window.partitionBy(*by).orderBy("date").rowsBetween(1 - window, 0)
    count: Column = F.when(F.count("breach").over(frame) == window, F.sum("breach").over(frame))
    return breaches.withColumn("breaches", count).withColumn("expected", F.lit(window * alpha))


def top_weights(weights: DataFrame, k: int = 10, by: Sequence[str] = ("book",)) -> DataFrame:
    nr = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("weight")), "ticker"))
    return weights.withColumn("nr", nr).where(F.col("nr") <= k)
