"""Backtests of VaR and ES forecasts: (series..., date, r, var, es)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import with_uniform
from . import returns as R, stats as S, var as V

#: 5 % points of the chi-square distribution with one and two degrees of freedom (fixed values).
CHI2_1, CHI2_2 = 3.841, 5.991


def breaches(forecast: DataFrame) -> DataFrame:
    return forecast.where("var is not null").withColumn("breach", (F.col("r") < -F.col("var")).cast("int"))


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, 0 for x = 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def lr_uc(n: Column, t: Column, alpha: Column) -> Column:
    """Kupiec's likelihood ratio of n breaches in t days."""
    null = xlogy(t - n, 1 - alpha) + xlogy(n, alpha)
    rate = n / t
    return -2 * (null - (xlogy(t - n, 1 - rate) + xlogy(n, rate)))


def upper_tail_chi2_1(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x): 1 - erf(y), y = sqrt(x / 2), by the series of positive terms."""
    y2 = F.least(F.greatest(x, F.lit(0.0)), F.lit(80.0)) / 2
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * 2 * y2 / (2 * i + 1)).alias("term"), (a["sum"] + a["term"] * 2 * y2 / (2 * i + 1)).alias("sum")),
    )["sum"]
    return F.greatest(1 - 2 / math.sqrt(math.pi) * F.sqrt(y2) * F.exp(-y2) * terms, F.lit(0.0))


#: Level of the simulated test of Z2 (fixed value).
Z2_LEVEL = 0.05


def simulated_z2(tested: DataFrame, level: Column, most: float, observed: DataFrame, n_boot: int, seed: int, by: Sequence[str]) -> DataFrame:
    """by, p_value, boot_mean: the share of n_boot simulated Z2 at or below the observed one (by, days, z2), and their mean.

    Breaches come at rate `level`, their losses are VaR + Exp(ES - VaR); other days add nothing. Numbers depend on seed, draw and
    day only (all series share them), so just days drawn below the largest level `most` become rows.
    """
    rows = tested.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("date"))).select(*by, "_i", "var", "es", level.alias("_level"))
    draws = rows.select("_i").distinct().withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = with_uniform(with_uniform(draws, "_u", ["_d", "_i", 1], seed).where(F.col("_u") < most), "_e", ["_d", "_i", 2], seed)
    loss = F.col("var") - F.ln("_e") * F.greatest(F.col("es") - F.col("var"), F.lit(1e-12))
    sums = rows.join(drawn, "_i").where("_u < _level").groupBy(*by, "_d").agg(F.sum(-loss / (F.col("_level") * F.col("es"))).alias("_s"))
    z = sums.join(observed, list(by)).withColumn("_z", F.col("_s") / F.col("days") + 1)
    found = z.groupBy(*by).agg(F.sum((F.col("_z") <= F.col("z2")).cast("long")).alias("_below"), F.count("*").alias("_drawn"), F.sum("_z").alias("_sum"))
    # a draw without a breach has Z2 = 0, as a series has; a negative VaR is breached by any return
    calm = rows.groupBy(*by).agg(F.when(F.bool_or(F.col("var") < 0), 1.0).otherwise(0.0).alias("_calm"))
    all_ = observed.join(calm, list(by)).join(found, list(by), "left").fillna(0, ["_below", "_drawn", "_sum"])
    rest = F.lit(n_boot) - F.col("_drawn")
    below = F.col("_below") + F.when(F.col("_calm") <= F.col("z2"), rest).otherwise(0)
    return all_.select(*by, (below / F.lit(n_boot)).alias("p_value"), ((F.col("_sum") + rest * F.col("_calm")) / F.lit(n_boot)).alias("boot_mean"))


def backtest(tested: DataFrame, alpha: float | str, by: Sequence[str] = ("book",), n_boot: int = 0, most_alpha: float | None = None, seed: int = 42) -> DataFrame:
    """All tests of each series from one window and one aggregate: Kupiec, Christoffersen, Z2, ES and loss on breach days.

    alpha: the level, or the name of the column in `by` that holds it (most_alpha: the largest one, 1 if not given). Without an es
    column what needs it is left out. n_boot: number of simulated Z2 for p_value, boot_mean and reject_z2; none without it.
    """
    level = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    before = F.lag("breach").over(Window.partitionBy(*by).orderBy("date"))
    t, hit = tested.withColumn("_before", before), F.col("breach") == 1
    sums = [F.sum("breach").alias("breaches"), F.count("*").alias("days"), *(F.sum(((F.col("_before") == a) & (F.col("breach") == b)).cast("int")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1))]
    if "es" in tested.columns:
        sums += [F.sum(F.when(hit, F.col("r") / (level * F.col("es")))).alias("_s"), F.avg(F.when(hit, F.col("es"))).alias("mean_es"), F.avg(F.when(hit, -F.col("r"))).alias("mean_loss")]
    g = t.groupBy(*by).agg(*sums)
    lr = lr_uc(F.col("breaches"), F.col("days"), level)
    g = g.withColumn("lr_uc", lr).withColumn("p_uc", upper_tail_chi2_1(F.col("lr_uc"))).withColumn("rate", F.col("breaches") / F.col("days")).withColumn("expected_rate", level).withColumn("reject_uc", F.col("lr_uc") > CHI2_1)
    # the pooled rate is that of the day before, as the method's source has it; a series of one day has no transition
    n00, n01, n10, n11 = (F.coalesce(F.col(f"n{a}{b}").cast("double"), F.lit(0.0)) for a in (0, 1) for b in (0, 1))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    p01, p11, pi = share(n01, n00 + n01), share(n11, n10 + n11), share(n10 + n11, n00 + n01 + n10 + n11)
    term = lambda n, p: F.when((n > 0) & (p > 0), n * F.ln(p)).otherwise(0.0)
    null = term(n00 + n10, 1 - pi) + term(n01 + n11, pi)
    free = term(n00, 1 - p01) + term(n01, p01) + term(n10, 1 - p11) + term(n11, p11)
    g = g.withColumn("pi01", p01).withColumn("pi11", p11).withColumn("lr_ind", -2 * (null - free))
    g = g.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind")).withColumn("p_cc", F.exp(-F.col("lr_cc") / 2)).withColumn("reject_cc", F.col("lr_cc") > CHI2_2)
    if "es" not in tested.columns:
        return g
    z2 = F.when(F.col("breaches") > 0, F.col("_s") / F.col("days") + 1).otherwise(0.0)
    g = g.withColumn("z2", z2).withColumn("es_ratio", F.try_divide("mean_loss", "mean_es")).drop("_s")
    if not n_boot:
        return g
    most = most_alpha or (1.0 if isinstance(alpha, str) else float(alpha))
    p = simulated_z2(tested, level, most, g.select(*by, "days", "z2"), n_boot, seed, by)
    return g.join(p, list(by)).withColumn("reject_z2", F.col("p_value") < Z2_LEVEL)


UC = ("breaches", "days", "lr_uc", "p_uc", "rate", "expected_rate", "reject_uc")
CC = ("n00", "n01", "n10", "n11", "pi01", "pi11", "lr_ind", "lr_cc", "p_cc", "reject_cc")


def kupiec(tested: DataFrame, alpha: float, by: Sequence[str] = ("book",)) -> DataFrame:
    return backtest(tested, alpha, by).select(*by, *UC)


def christoffersen(tested: DataFrame, alpha: float, by: Sequence[str] = ("book",)) -> DataFrame:
    """Independence and conditional coverage."""
    return backtest(tested, alpha, by).select(*by, *UC, *CC)


def acerbi_z2(tested: DataFrame, alpha: float, by: Sequence[str] = ("book",)) -> DataFrame:
    """Z2 = sum over breaches of r / (alpha ES) / T + 1, 0 without a breach; mean ES and loss on breach days."""
    return backtest(tested, alpha, by).select(*by, "days", "breaches", "mean_es", "mean_loss", "z2", "es_ratio")


def acerbi_p_value(tested: DataFrame, alpha: float, n_boot: int = 10_000, seed: int = 42, by: Sequence[str] = ("book",)) -> DataFrame:
    """Z2 with the left-tail share of simulated Z2 below it, their mean and the verdict."""
    return backtest(tested, alpha, by, n_boot, seed=seed).select(*by, "breaches", "z2", "p_value", "boot_mean", "reject_z2")


def full_grid(returns: DataFrame, window: int, alphas: Sequence[float] = (0.01, 0.05), methods: Sequence[str] = V.METHODS, by: Sequence[str] = ("book",), n_boot: int = 3000) -> DataFrame:
    """One row for each series, method and level with all tests; forecasts and tests each take one pass."""
    tested = breaches(V.forecast_grid(returns, window, alphas, methods, by))
    return backtest(tested, "alpha", [*by, "method", "alpha"], n_boot, max(alphas)).withColumn("expected_breaches", F.col("days") * F.col("alpha"))


def cell_summary(grid: DataFrame, by: Sequence[str] = ("book",)) -> DataFrame:
    """The figures of each cell that are shown: breach rate and number, verdicts, consecutive breaches, ES against loss, Z2."""
    return grid.select(
        *by, "method", "alpha", F.col("rate").alias("breach_rate"), F.col("breaches").alias("breach_n"), F.col("reject_uc").alias("kupiec_reject"), F.col("reject_cc").alias("christ_reject"),
        "n11", F.col("mean_loss").alias("es_real"), F.col("mean_es").alias("es_pred"), "es_ratio", F.col("z2").alias("acerbi_z2"), F.col("p_value").alias("acerbi_p"), F.col("reject_z2").alias("acerbi_reject"),
    )


def multi_backtest(prices: DataFrame, weights: DataFrame, market: str, window: int, alphas: Sequence[float] = (0.05, 0.01), methods: Sequence[str] = ("parametric", "historic"), shared_dates: bool = False) -> DataFrame:
    """Many books over one price panel: a row for each book, method and level with the book's period, exposures and beta.

    Each book's returns come from its own tickers; with shared_dates only dates that all books have are used.
    """
    r = R.book_returns(prices, weights)
    r = R.common_window(r) if shared_dates else r
    of_market = R.simple_returns(prices.where(F.col("ticker") == market)).select("date", F.col("r").alias("m"))
    beta = S.realized_beta(r.join(of_market, "date", "left"), "r", "m").withColumnRenamed("n", "beta_n").withColumnRenamed("alpha", "beta_alpha")
    period = r.groupBy("book").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count("*").alias("obs"))
    cells = cell_summary(full_grid(r, window, alphas, methods))
    return cells.join(period, "book").join(R.exposures(weights), "book").join(beta, "book", "left")
