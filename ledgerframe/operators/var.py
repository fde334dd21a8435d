"""Rolling VaR and expected shortfall of return series (positive losses), one row for each day with a full window.

A forecast for a day uses the rows before it only. `by` names the series columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import linear_quantile, mean_of, mean_up_to_quantile, states_before
from ..functions.checks import require_known
from ..functions.draws import quantile_ranks, resampled_ranks, with_uniforms

_NORMAL = NormalDist()
METHODS = ("parametric", "historic", "fhs")


def _before(window: int, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("date").rowsBetween(-window, -1)


def check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha {alpha} is not within (0, 1)")


def _forecast(returns: DataFrame, window: int, by: Sequence[str], var: Column, es: Column) -> DataFrame:
    full = F.row_number().over(Window.partitionBy(*by).orderBy("date"))
    rows = returns.withColumn("_var", var).withColumn("_es", es).withColumn("_nr", full)
    return rows.where(F.col("_nr") > window).select(*by, "date", "r", F.col("_var").alias("var"), F.col("_es").alias("es"))


def rolling_parametric(returns: DataFrame, window: int, alpha: float, by: Sequence[str] = ("book",)) -> DataFrame:
    """Normal VaR and ES at tail probability alpha, sample deviation."""
    check_alpha(alpha)
    z = _NORMAL.inv_cdf(alpha)
    frame = _before(window, by)
    mu, s = F.avg("r").over(frame), F.stddev_samp("r").over(frame)
    return _forecast(returns, window, by, -(mu + F.lit(z) * s), -(mu - s * F.lit(_NORMAL.pdf(z) / alpha)))


def rolling_historic(returns: DataFrame, window: int, alpha: float, by: Sequence[str] = ("book",)) -> DataFrame:
    """Exact quantile and the mean strictly below it (the quantile itself if nothing is)."""
    check_alpha(alpha)
    rows = returns.withColumn("_pool", F.sort_array(F.collect_list("r").over(_before(window, by))))
    q = linear_quantile(F.col("_pool"), alpha)
    return _forecast(rows, window, by, -q, -historic_tail(F.col("_pool"), alpha))


def historic_tail(pool: Column, alpha: float) -> Column:
    """Mean strictly below the quantile of an ascending pool, the quantile itself if nothing is."""
    return F.coalesce(mean_up_to_quantile(pool, alpha, strict=True), linear_quantile(pool, alpha))


def ewma_filter(returns: DataFrame, lam: float, seed: Column, by: Sequence[str] = ("book",)) -> DataFrame:
    """sigma2 and z = r / sigma of the recursion sigma2[t] = lam sigma2[t-1] + (1-lam) r[t-1]^2, sigma2[0] = seed.

    seed: an expression over the columns _r (array of a series' returns in date order). One fold for each series.
    """
    lists = returns.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", "r"))).alias("_p")).withColumn("_r", F.col("_p.r"))
    sigma2 = states_before(F.col("_r"), seed.cast("double"), lambda a, x: a * lam + x * x * (1 - lam))
    rows = lists.withColumn("_s", sigma2).select(*by, F.explode(F.arrays_zip("_p", "_s")).alias("e"))
    return rows.select(*by, F.col("e._p.date").alias("date"), F.col("e._p.r").alias("r"), F.col("e._s").alias("sigma2"), F.try_divide(F.col("e._p.r"), F.sqrt("e._s")).alias("z"))


def var_pop_of(window: int) -> Column:
    """Population variance of the first `window` entries of _r."""
    first = F.slice("_r", 1, window)
    mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
    return F.aggregate(F.transform(first, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(first)


def rolling_fhs(returns: DataFrame, window: int, alpha: float, lam: float = 0.94, by: Sequence[str] = ("book",)) -> DataFrame:
    """Filtered historical simulation: quantile and tail mean (up to the quantile) of standardised returns, times sigma."""
    check_alpha(alpha)
    z = ewma_filter(returns, lam, var_pop_of(window), by)
    rows = z.withColumn("_pool", F.sort_array(F.collect_list("z").over(_before(window, by))))
    q, sigma = linear_quantile(F.col("_pool"), alpha), F.sqrt("sigma2")
    return _forecast(rows, window, by, -q * sigma, -mean_up_to_quantile(F.col("_pool"), alpha, strict=False) * sigma)


def rolling_fhs_bootstrap(returns: DataFrame, window: int, alpha: float, n_boot: int = 1000, lam: float = 0.94, seed: int = 42, by: Sequence[str] = ("book",)) -> DataFrame:
    """rolling_fhs with resampled quantiles: VaR from the mean quantile of n_boot resamples of a day's pool, ES from its tail up to the quantile
    of one draw of n_boot values (null with an empty tail); n_tail is the number of values in it.

    Resamples are drawn as places in the sorted pool, the same for every day and series: the mean over resampled quantiles
    is a weighted sum over the pool, whose weights (one for each place at most) are worked out once.
    """
    check_alpha(alpha)
    spark, (_, _, part) = returns.sparkSession, quantile_ranks(window, alpha)
    ends = F.explode(F.array(F.struct(F.col("low").alias("place"), F.lit(1 - part).alias("w")), F.struct(F.col("high").alias("place"), F.lit(part).alias("w"))))
    weights = resampled_ranks(spark, window, window, n_boot, alpha, seed).select(ends.alias("e")).groupBy("e.place").agg((F.sum("e.w") / n_boot).alias("w"))
    bag = weights.agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("_bag"))
    one = resampled_ranks(spark, window, n_boot, 1, alpha, seed + 1).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = ewma_filter(returns, lam, var_pop_of(window), by).withColumn("_pool", F.sort_array(F.collect_list("z").over(_before(window, by))))
    rows = rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*by).orderBy("date"))).where(F.col("_nr") > window).crossJoin(F.broadcast(bag)).crossJoin(F.broadcast(one))  # one row each
    q = F.aggregate("_bag", F.lit(0.0), lambda s, x: s + x["w"] * F.get("_pool", x["place"]))
    edge = F.get("_pool", F.col("_low")) + (F.get("_pool", F.col("_high")) - F.get("_pool", F.col("_low"))) * quantile_ranks(n_boot, alpha)[2]
    rows = rows.withColumn("_edge", edge).withColumn("_tail", F.filter("_pool", lambda x: x <= F.col("_edge")))
    return rows.select(*by, "date", "r", (-q * F.sqrt("sigma2")).alias("var"), (-mean_of(F.col("_tail")) * F.sqrt("sigma2")).alias("es"), F.size("_tail").alias("n_tail"))


def forecast_grid(returns: DataFrame, window: int, alphas: Sequence[float], methods: Sequence[str], by: Sequence[str] = ("book",), lam: float = 0.94) -> DataFrame:
    """Forecasts of all methods and levels in one pass: by, method, alpha, date, r, var, es. Each day's pools are sorted once."""
    for alpha in alphas:
        check_alpha(alpha)
    if unknown := set(methods) - set(METHODS):
        raise KeyError(*unknown)
    frame = _before(window, by)
    rows = ewma_filter(returns, lam, var_pop_of(window), by) if "fhs" in methods else returns
    rows = rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*by).orderBy("date"))).withColumns({"_mu": F.avg("r").over(frame), "_sd": F.stddev_samp("r").over(frame), "_rs": F.collect_list("r").over(frame)})
    rows = (rows.withColumn("_zs", F.collect_list("z").over(frame)) if "fhs" in methods else rows).where(F.col("_nr") > window)
    rows = rows.withColumns({c: F.sort_array(c) for c in ("_rs", "_zs") if c in rows.columns})

    def cell(method: str, alpha: float) -> Column:
        if method == "parametric":
            z = _NORMAL.inv_cdf(alpha)
            var, es = -(F.col("_mu") + z * F.col("_sd")), -(F.col("_mu") - F.col("_sd") * (_NORMAL.pdf(z) / alpha))
        elif method == "historic":
            q = linear_quantile(F.col("_rs"), alpha)
            var, es = -q, -historic_tail(F.col("_rs"), alpha)
        else:
            q = linear_quantile(F.col("_zs"), alpha)
            var, es = -q * F.sqrt("sigma2"), -mean_up_to_quantile(F.col("_zs"), alpha, strict=False) * F.sqrt("sigma2")
        return F.struct(F.lit(method).alias("method"), F.lit(float(alpha)).alias("alpha"), var.alias("var"), es.alias("es"))

    cells = F.explode(F.array(*[cell(m, a) for m in methods for a in alphas]))
    return rows.select(*by, "date", "r", cells.alias("_c")).select(*by, "_c.method", "_c.alpha", "date", "r", "_c.var", "_c.es")


def rolling_var_es(returns: DataFrame, window: int, alpha: float, method: str, by: Sequence[str] = ("book",)) -> DataFrame:
    if method not in METHODS:
        raise KeyError(method)
    return {"parametric": rolling_parametric, "historic": rolling_historic, "fhs": rolling_fhs}[method](returns, window, alpha, by=by)


def normal_var(sigma: Column, confidence: float, horizon: float = 1.0, mu: Column | float = 0.0) -> Column:
    return F.lit(_NORMAL.inv_cdf(confidence) * math.sqrt(horizon)) * sigma - mu * F.lit(float(horizon))


def normal_es(sigma: Column, confidence: float, horizon: float = 1.0, mu: Column | float = 0.0) -> Column:
    return F.lit(_NORMAL.pdf(_NORMAL.inv_cdf(confidence)) / (1 - confidence) * math.sqrt(horizon)) * sigma - mu * F.lit(float(horizon))


def rolling_confidence(returns: DataFrame, confidence: float, window: int, vol_method: str = "rolling", lam: float = 0.94, horizon: float = 1.0, by: Sequence[str] = ("book",)) -> DataFrame:
    """mu, sigma, var, es at a confidence level; null while the window is not full. vol_method: rolling or ewma."""
    frame = _before(window, by)
    full = F.count("r").over(frame) == window
    mu = F.when(full, F.avg("r").over(frame))
    if vol_method == "rolling":
        rows = returns.withColumn("mu", mu).withColumn("sigma", F.when(full, F.stddev_samp("r").over(frame)))
    elif vol_method == "ewma":
        # adjust=False: seeded with the first square, includes the day itself, then moved one day on
        first = F.pow(F.element_at("_r", 1), 2)
        f = ewma_filter(returns, lam, first, by)
        level = lam * F.col("sigma2") + (1 - lam) * F.col("r") * F.col("r")
        order = Window.partitionBy(*by).orderBy("date")
        f = f.withColumn("_level", F.when(F.row_number().over(order) == 1, F.col("sigma2")).otherwise(level))
        rows = f.withColumn("mu", mu).withColumn("sigma", F.when(full, F.sqrt(F.lag("_level").over(order))))
    else:
        raise ValueError(f"vol_method: rolling or ewma, not {vol_method!r}")
    return rows.select(*by, "date", "r", "mu", "sigma", normal_var(F.col("sigma"), confidence, horizon, F.col("mu")).alias("var"), normal_es(F.col("sigma"), confidence, horizon, F.col("mu")).alias("es"))


def portfolio_sigma(weights: DataFrame, cov: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """sqrt(w' cov w) for each book; cov is (ticker_i, ticker_j, cov). A ticker without a covariance is an error."""
    weights = require_known(weights, cov.select(F.col("ticker_i").alias("ticker")), "ticker", "no covariance for")
    i = weights.select(*by, F.col("ticker").alias("ticker_i"), F.col("weight").alias("wi"))
    j = weights.select(*by, F.col("ticker").alias("ticker_j"), F.col("weight").alias("wj"))
    both = i.join(cov, "ticker_i").join(j, [*by, "ticker_j"])
    return both.groupBy(*by).agg(F.sqrt(F.sum(F.col("wi") * F.col("cov") * F.col("wj"))).alias("sigma"))


def bootstrap_quantile(returns: DataFrame, alpha: float, n_boot: int = 5000, ci: float = 0.95, seed: int = 42, by: Sequence[str] = ("book",)) -> DataFrame:
    """Point quantile, its standard error (population) and a percentile interval from n_boot resamples of each series.

    A resample is drawn as places in the sorted series, once for each length of series.
    """
    check_alpha(alpha)
    pools = returns.groupBy(*by).agg(F.sort_array(F.collect_list("r")).alias("_pool")).withColumn("_n", F.size("_pool"))
    draws = pools.select("_n").distinct().withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).repartition(returns.sparkSession.sparkContext.defaultParallelism, "_n", "_d")  # few small rows, but much work for each
    places = with_uniforms(draws, "_u", ["_d"], F.col("_n"), seed)
    ordered = places.select("_n", F.sort_array(F.transform("_u", lambda u: F.floor(u * F.col("_n")).cast("int"))).alias("_a"))
    at = (F.col("_n") - 1) * F.lit(alpha)
    of = lambda place: F.get("_a", F.least(F.col("_n") - 1, place.cast("int")))
    ends = ordered.select("_n", of(F.floor(at)).alias("_low"), of(F.floor(at) + 1).alias("_high"), (at - F.floor(at)).alias("_part"))
    pick = lambda c: F.get("_pool", F.col(c))
    q = pools.join(ends, "_n").select(*by, (pick("_low") + (pick("_high") - pick("_low")) * F.col("_part")).alias("_q"))
    tail = (1 - ci) / 2
    spread = q.groupBy(*by).agg(F.stddev_pop("_q").alias("se"), F.percentile("_q", F.lit(tail)).alias("lo"), F.percentile("_q", F.lit(1 - tail)).alias("hi"))
    return pools.select(*by, linear_quantile(F.col("_pool"), alpha).alias("point")).join(spread, list(by))
