"""Model portfolios as tables (model_id, ticker, weight): checks, edits, and what a change does. Many models at once; `by` names what tells them apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import require_known

#: How far the weights of a model may sum from 1, and the least change of a weight that counts as one (fixed values).
WEIGHT_TOLERANCE, CHANGE_TOLERANCE = 1e-9, 0.0005


def _problem(w: Window | None) -> Column:
    """What is wrong with a model's weights, null if nothing is: as a window's column, or as an aggregate where w is None."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    weight = F.col("weight")
    wrong = weight.isNull() | F.isnan(weight) | (weight < 0) | (weight == float("inf"))
    named = F.concat(F.lit("negative or non-finite weights: "), F.array_join(F.array_sort(over(F.collect_set(F.when(wrong, F.col("ticker"))))), ", "))
    total = over(F.sum("weight"))
    summed = F.concat(F.lit("weights sum to "), total.cast("string"), F.lit(", not 1"))
    return F.when(over(F.count_if(wrong)) > 0, named).when(F.abs(total - 1) > WEIGHT_TOLERANCE, summed)


def problems(models: DataFrame, listed: DataFrame | None = None, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """by and reason of each model that cannot be followed: weights that are negative, not finite or missing (with their tickers), or that do
    not sum to 1; and models of `listed` (by columns) without any row: empty model."""
    found = models.groupBy(*by).agg(_problem(None).alias("reason"))
    if listed is not None:
        found = listed.select(*by).distinct().join(found.withColumn("_there", F.lit(True)), list(by), "left")
        found = found.withColumn("reason", F.when(F.col("_there").isNull(), "empty model").otherwise(F.col("reason"))).drop("_there")
    return found.where("reason is not null")


def require_valid(models: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """The rows; a model that `problems` would name is an error, whichever columns are read."""
    rows = models.withColumn("_problem", _problem(Window.partitionBy(*by)))
    named = F.concat_ws(": ", *[F.col(c).cast("string") for c in by], F.col("_problem"))
    return rows.where(F.when(F.col("_problem").isNull(), True).otherwise(F.raise_error(named).cast("boolean"))).drop("_problem")


def parsed_edits(edits: DataFrame) -> DataFrame:
    """Adds source, target and size of an edit "FROM:TO:SIZE"; text of another form is an error."""
    part = F.split("edit", ":")
    bad = F.raise_error(F.concat(F.lit("an edit must look like FROM:TO:SIZE, not "), F.coalesce("edit", F.lit("null"))))
    rows = edits.withColumn("source", F.get(part, F.lit(0))).withColumn("target", F.get(part, F.lit(1))).withColumn("size", F.get(part, F.lit(2)).try_cast("double"))
    good = (F.size(part) == 3) & F.col("size").isNotNull()
    return rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(bad.cast("boolean")))


def apply_edits(models: DataFrame, edits: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """by, version, ticker, weight of each edited model: `size` of weight moved from one ticker to another, weights of 0 left out.

    models: by, version, ticker, weight; edits: by, edit (at most one a model). Errors: an edit of a model that is not there or that holds less
    of the source than it would move, and an edited model whose weights are not those of a model.
    """
    by = list(by)
    moves = parsed_edits(require_known(edits, models, by, "no model")).select(*by, "source", "target", "size")
    again = F.raise_error(F.concat_ws(" ", F.lit("several edits of"), *[F.col(c).cast("string") for c in by]))
    alone = F.count(F.lit(1)).over(Window.partitionBy(*by))
    moves = moves.withColumn("_n", alone).where(F.when(F.col("_n") == 1, True).otherwise(again.cast("boolean"))).drop("_n")
    rows = models.select(*by, "version", "ticker", F.col("weight").cast("double").alias("weight"))
    held = moves.join(rows.select(*by, F.col("ticker").alias("source"), F.col("weight").alias("held")), [*by, "source"], "left").fillna(0.0, ["held"])
    short = F.raise_error(F.concat_ws(" ", *[F.col(c).cast("string") for c in by], F.lit("holds"), F.col("held").cast("string"), F.lit("of"), F.col("source"), F.lit("and cannot give"), F.col("size").cast("string")))
    moves = held.where(F.when(F.col("held") >= F.col("size"), True).otherwise(short.cast("boolean")))
    legs = moves.select(*by, F.explode(F.array(F.struct(F.col("source").alias("ticker"), (-F.col("size")).alias("weight")), F.struct(F.col("target").alias("ticker"), F.col("size").alias("weight")))).alias("x"))
    # the version of the edited model stands with its rows; those of the edit have none
    named = F.concat(F.max("version"), F.lit("+"), F.max("source"), F.lit("->"), F.max("target"))
    names = rows.join(moves, by).groupBy(*by).agg(named.alias("version"))
    kept = rows.join(moves.select(*by), by, "left_semi").select(*by, "ticker", "weight").unionByName(legs.select(*by, "x.ticker", "x.weight"))
    out = kept.groupBy(*by, "ticker").agg(F.sum("weight").alias("weight")).where("weight > 0").join(names, by)
    return require_valid(out.select(*by, "version", "ticker", "weight"), by)


def sides(old: DataFrame, new: DataFrame, benchmark: DataFrame | None = None, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """by, ticker, old, new, bench (0 where a side lacks the ticker), has_bench: one aggregate over all sides."""
    tag = lambda rows, n: rows.select(*by, "ticker", *[(F.col("weight") if i == n else F.lit(0.0)).alias(c) for i, c in enumerate(("old", "new", "bench"))], F.lit(n == 2).alias("has_bench"))
    rows = tag(old, 0).unionByName(tag(new, 1))
    if benchmark is not None:
        compared = rows.select(*by).distinct()
        rows = rows.unionByName(tag(benchmark.join(compared, list(by), "left_semi"), 2))
    flat = rows.groupBy(*by, "ticker").agg(*[F.sum(c).alias(c) for c in ("old", "new", "bench")], F.bool_or("has_bench").alias("has_bench"))
    return flat.withColumn("has_bench", F.bool_or("has_bench").over(Window.partitionBy(*by)))


def change_summary(old: DataFrame, new: DataFrame, cov: DataFrame, benchmark: DataFrame | None = None, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """One row a model: one-way turnover, number of changed weights, and the tracking errors of new against old and of either against the
    benchmark (null without one). A ticker without a covariance is an error.

    The three quadratic forms share one product with the covariances (ticker_i, ticker_j, cov).
    """
    by = list(by)
    rows = require_known(sides(old, new, benchmark, by), cov.select(F.col("ticker_i").alias("ticker")), "ticker", "no covariance for")
    d = {"change": F.col("new") - F.col("old"), "te_old": F.col("old") - F.col("bench"), "te_new": F.col("new") - F.col("bench")}
    rows = rows.select(*by, "ticker", "has_bench", *[x.alias(c) for c, x in d.items()])
    turned = rows.join(cov, F.col("ticker") == F.col("ticker_i")).groupBy(*by, F.col("ticker_j").alias("ticker")).agg(*[F.sum(F.col(c) * F.col("cov")).alias(f"{c}_y") for c in d])
    root = lambda c: F.sqrt(F.greatest(F.sum(F.col(c) * F.col(f"{c}_y")), F.lit(0.0)))
    bench = lambda c: F.when(F.bool_or("has_bench"), root(c))
    # every ticker has covariances, so the join keeps every row
    return rows.join(turned, [*by, "ticker"]).groupBy(*by).agg(
        (F.sum(F.abs("change")) / 2).alias("turnover"), F.count_if(F.abs("change") > CHANGE_TOLERANCE).alias("n_changed"), root("change").alias("te_old_new"), bench("te_old").alias("te_old_bench"), bench("te_new").alias("te_new_bench")
    )


def change_by_sleeve(old: DataFrame, new: DataFrame, sleeve_of: DataFrame, aum: float | None = None, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """by, sleeve, diff and flow (diff in money, null without assets): the change of weight in each sleeve. A ticker without a sleeve is an error."""
    rows = require_known(sides(old, new, None, by), sleeve_of, "ticker", "no sleeve for").join(sleeve_of, "ticker")
    change = rows.groupBy(*by, "sleeve").agg(F.sum(F.col("new") - F.col("old")).alias("diff"))
    return change.withColumn("flow", F.col("diff") * F.lit(aum).cast("double"))
