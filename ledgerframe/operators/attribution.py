"""Brinson-Fachler attribution and implementation effects of many accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import require_known

#: Upper bounds of the size buckets, right-closed (fixed values).
SIZE_BUCKETS = ((25_000.0, "<=25k"), (100_000.0, "25k-100k"), (500_000.0, "100k-500k"))
LARGEST = ">500k"


def sleeves(weights: DataFrame, growth: DataFrame, sleeve_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weight and return of each sleeve with a weight: weights (ticker, weight), growth (ticker, growth), sleeve_of (ticker, sleeve).

    A ticker without growth or without a sleeve is an error.
    """
    at = [*(c for c in by if c in growth.columns), "ticker"]
    rows = require_known(require_known(weights, growth, at, "no growth for"), sleeve_of, "ticker", "no sleeve for").join(growth, at).join(sleeve_of, "ticker")
    g = rows.groupBy(*by, "sleeve").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * (F.col("growth") - 1)).alias("gain"))
    return g.where("w > 0").select(*by, "sleeve", "w", (F.col("gain") / F.col("w")).alias("r"))


def brinson(portfolio: DataFrame, benchmark: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Allocation, selection, interaction for each sleeve of either side; a sleeve that one side lacks borrows the other's return."""
    p = portfolio.select(*by, "sleeve", F.col("w").alias("wp"), F.col("r").alias("rp"))
    b = benchmark.select(*by, "sleeve", F.col("w").alias("wb"), F.col("r").alias("rb"))
    both = p.join(b, [*by, "sleeve"], "full")
    total = b.groupBy(*by).agg(F.sum(F.col("wb") * F.col("rb")).alias("total"))
    both = both.join(total, list(by)) if by else both.crossJoin(F.broadcast(total))
    both = both.withColumn("wp", F.coalesce("wp", F.lit(0.0))).withColumn("wb", F.coalesce("wb", F.lit(0.0))).withColumn("rp_", F.coalesce("rp", "rb")).withColumn("rb_", F.coalesce("rb", "rp"))
    active = F.col("wp") - F.col("wb")
    return both.select(*by, "sleeve", (active * (F.col("rb_") - F.col("total"))).alias("allocation"), (F.col("wb") * (F.col("rp_") - F.col("rb_"))).alias("selection"), (active * (F.col("rp_") - F.col("rb_"))).alias("interaction"))


def started(accounts: DataFrame, models: DataFrame, end) -> DataFrame:
    """account_id, model_id, cash, start of the accounts with a start date and a listed model; a start at or after `end` is an error."""
    rows = accounts.where("last_rebalanced is not null").join(models.select("model_id").distinct(), "model_id", "left_semi").select("account_id", "model_id", "cash", F.col("last_rebalanced").alias("start"))
    late = F.raise_error(F.concat(F.col("account_id").cast("string"), F.lit(": starts at "), F.col("start").cast("string"), F.lit(f", not before {end}")))
    return rows.where(F.when(F.col("start") < F.lit(end), True).otherwise(late.cast("boolean")))


def implementation_effects(accounts: DataFrame, holdings: DataFrame, models: DataFrame, prices: DataFrame, end) -> DataFrame:
    """What each account's return owes to drift, cash and rounding between its last rebalance and `end`.

    accounts: account_id, model_id, cash, last_rebalanced; prices: ticker, date, price. Accounts without a start date or with a model
    that is not listed are left out. A start that is not before `end`, and a held or model ticker without a price at either, is an error.
    """
    px = prices.select("ticker", "date", "price")
    last = px.where(F.col("date") == F.lit(end)).select("ticker", F.col("price").alias("p1"))
    starts = started(accounts, models, end)
    growth = px.withColumnRenamed("price", "p0").withColumnRenamed("date", "start").join(last, "ticker").withColumn("growth", F.col("p1") / F.col("p0"))
    # the model's own path depends on the start date only: one row for each model and date
    spans = starts.select("model_id", "start").distinct()
    daily = _model_daily(models, px)
    mixed = spans.join(daily, "model_id").where((F.col("date") > F.col("start")) & (F.col("date") <= F.lit(end))).groupBy("model_id", "start").agg((F.product(1 + F.col("r")) - 1).alias("model_rebalanced"))
    hold = require_known(spans.join(models, "model_id"), growth, ["ticker", "start"], "no price at start or end for").join(growth, ["ticker", "start"]).groupBy("model_id", "start").agg((F.sum(F.col("weight") * F.col("growth")) - 1).alias("model_buy_hold"))
    own = require_known(starts.join(holdings.where("shares <> 0"), "account_id"), growth, ["ticker", "start"], "no price at start or end for").join(growth, ["ticker", "start"]).groupBy("account_id").agg(F.sum(F.col("shares") * F.col("p0")).alias("held0"), F.sum(F.col("shares") * F.col("p0") * F.col("growth")).alias("held1"))
    rows = starts.join(mixed, ["model_id", "start"], "left").fillna(0.0, ["model_rebalanced"]).join(hold, ["model_id", "start"]).join(own, "account_id", "left").fillna(0.0, ["held0", "held1"])
    rows = rows.withColumn("value_start", F.col("held0") + F.col("cash")).where("value_start <> 0")
    c0 = F.col("cash") / F.col("value_start")
    invested = F.coalesce(F.try_divide(F.col("held1"), F.col("held0")) - 1, F.lit(0.0))
    rows = rows.withColumn("account", (F.col("held1") + F.col("cash")) / F.col("value_start") - 1)
    bh = F.col("model_buy_hold")
    return rows.select(
        "account_id", "model_id", "start", "value_start", c0.alias("cash_start"), "model_rebalanced", "model_buy_hold", "account", (bh - F.col("model_rebalanced")).alias("drift_effect"),
        (-c0 * bh).alias("cash_effect"), ((1 - c0) * (invested - bh)).alias("rounding_effect"), (F.col("account") - F.col("model_rebalanced")).alias("total"),
    )


def attribution_table(accounts: DataFrame, holdings: DataFrame, models: DataFrame, benchmarks: DataFrame, prices: DataFrame, end, sleeve_of: DataFrame) -> DataFrame:
    """One row per account with a start date, a known model and a benchmark for it: benchmark, model and account return, the sleeve effects
    of model against benchmark, and cash, rounding and drift of the account; active = account - benchmark is their sum.

    Sleeve effects depend on model and start only, so they are found once for each such pair. benchmarks: model_id, ticker, weight.
    """
    effects = implementation_effects(accounts, holdings, models, prices, end)
    by = ["model_id", "start"]
    # which pairs there are comes from the accounts, not from the effects: those are read once
    spans = started(accounts, models, end).select("model_id", "start").distinct()
    px = prices.select("ticker", "date", "price")
    last = px.where(F.col("date") == F.lit(end)).select("ticker", F.col("price").alias("p1"))
    growth = px.join(last, "ticker").select("ticker", F.col("date").alias("start"), (F.col("p1") / F.col("price")).alias("growth"))
    of_model, of_bench = spans.join(models, "model_id"), spans.join(benchmarks, "model_id")
    sides = [sleeves(w.select(*by, "ticker", "weight"), growth, sleeve_of, by) for w in (of_model, of_bench)]
    total = brinson(*sides, by).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")])
    bench = of_bench.join(growth, ["ticker", "start"]).groupBy(*by).agg(F.sum(F.col("weight") * (F.col("growth") - 1)).alias("benchmark"))
    rows = effects.join(bench, by).join(total, by)
    return rows.select(
        "account_id", *by, "benchmark", F.col("model_buy_hold").alias("model"), "account", "allocation", "selection", "interaction",
        F.col("cash_effect").alias("cash"), F.col("rounding_effect").alias("rounding"), F.col("drift_effect").alias("drift"), (F.col("account") - F.col("benchmark")).alias("active"),
    )


def _model_daily(models: DataFrame, prices: DataFrame) -> DataFrame:
    from .returns import simple_returns

    own = prices.join(models.select("model_id", "ticker"), "ticker")
    r = simple_returns(own, ["model_id"], "any").join(models, ["model_id", "ticker"])
    return r.groupBy("model_id", "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def size_bucket(value: Column) -> Column:
    """Name of the bucket of an account's value (a value on a bound belongs below it); null for values of 0 and less."""
    size = F.lit(LARGEST)
    for bound, name in reversed(SIZE_BUCKETS):
        size = F.when(value <= bound, name).otherwise(size)
    return F.when(value > 0, size)


def by_size(effects: DataFrame) -> DataFrame:
    """By account size (a value on a bound belongs below it; values of 0 and less have no size): number of accounts, median share of cash
    at the start, medians of all effects and of the total, and the worst total, in basis points."""
    size = size_bucket(F.col("value_start"))
    median = lambda c: (F.percentile(c, F.lit(0.5)) * 1e4).alias
    return effects.where("value_start > 0").groupBy(size.alias("size")).agg(
        F.count("*").alias("n"), F.percentile("cash_start", F.lit(0.5)).alias("cash_start"), median("drift_effect")("drift_bp"), median("cash_effect")("cash_bp"), median("rounding_effect")("rounding_bp"),
        median("total")("median_bp"), (F.min("total") * 1e4).alias("min_bp"),
    )


def by_model(effects: DataFrame) -> DataFrame:
    return effects.groupBy("model_id").agg((F.percentile("total", F.lit(0.5)) * 1e4).alias("median_bp"), F.count("*").alias("n"))
