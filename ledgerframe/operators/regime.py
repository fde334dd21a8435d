"""Macro regime: z-scores, composite score, posterior, policy, forward returns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.symmetric import principal_axis

#: Parameters of the score and of the mixture (fixed values).
LABELS = ("risk_off", "soft_patch", "risk_on")
MIXTURE_MEANS = (20.0, 50.0, 80.0)
MIXTURE_SIGMA = 15.0


@dataclass(frozen=True)
class ScoreWeights:
    base: float = 50.0
    vix: float = -12.0
    dxy: float = -8.0
    ief: float = -6.0
    pca: float = -6.0


def rolling_zscore(series: DataFrame, value: str, window: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """z of every row against the last `window` values, itself included; null while short or without variance."""
    rows = series.where(F.col(value).isNotNull())
    order = Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date")
    frame = order.rowsBetween(1 - window, 0)
    sd = F.stddev_samp(value).over(frame)
    z = F.when((F.count(value).over(frame) == window) & (sd > 0), (F.col(value) - F.avg(value).over(frame)) / sd)
    return rows.withColumn("z", z)


def trailing_zscore(series: DataFrame, value: str, window: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """The last row's z."""
    z = rolling_zscore(series, value, window, by)
    pick = F.max_by(F.struct("z"), "date").alias("s")
    return (z.groupBy(*by).agg(pick) if by else z.agg(pick)).select(*by, F.col("s.z").alias("z"))


def s_curve_penalty(z: Column, height: float = 20.0, slope: float = 1.2, centre: float = 0.0) -> Column:
    return F.when(z.isNull(), 0.0).otherwise(-height / (1 + F.exp(-slope * (z - centre))))


def credit_asym(z: Column, down: float = 15.0, up: float = 5.0) -> Column:
    return F.when(z.isNull(), 0.0).when(z >= 0, up * z).otherwise(-down * F.abs(z))


def composite_score(vix: Column, dxy: Column, ief: Column, credit: Column, pca: Column | None = None, w: ScoreWeights = ScoreWeights()) -> Column:
    """Linear terms, the VIX penalty and the asymmetric credit term, within [0, 100]."""
    zero = F.lit(0.0)
    raw = w.base + w.vix * F.coalesce(vix, zero) + w.dxy * F.coalesce(dxy, zero) + w.ief * F.coalesce(ief, zero) + s_curve_penalty(vix) + credit_asym(credit)
    if pca is not None:
        raw = raw + w.pca * F.coalesce(pca, zero)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def mixture_posterior(scores: DataFrame, score: str = "score", means: Sequence[float] = MIXTURE_MEANS, sigma: float = MIXTURE_SIGMA, prior: Sequence[float] | None = None) -> DataFrame:
    """Adds posterior_<label>; uniform for a missing score or where all likelihoods vanish."""
    prior = prior or [1 / len(means)] * len(means)
    like = [F.lit(p) * F.exp(-0.5 * F.pow((F.col(score) - m) / sigma, 2)) for p, m in zip(prior, means)]
    total = sum(like[1:], like[0])
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (total > 0)
    return scores.withColumns({f"posterior_{label}": F.when(ok, x / total).otherwise(1 / len(means)) for label, x in zip(LABELS, like)})


def policy(posteriors: DataFrame) -> DataFrame:
    """gross_target and beta_cap from how far risk_on outweighs risk_off."""
    tilt = F.col("posterior_risk_on") - F.col("posterior_risk_off")
    return posteriors.withColumn("gross_target", 100 + 40 * tilt).withColumn("beta_cap", 0.3 + 0.4 * tilt)


def label_from_posterior(posteriors: DataFrame) -> DataFrame:
    """The most likely label; ties go to the first of risk_off, soft_patch, risk_on."""
    off, soft, on = (F.col(f"posterior_{x}") for x in LABELS)
    return posteriors.withColumn("label", F.when((off >= soft) & (off >= on), LABELS[0]).when(soft >= on, LABELS[1]).otherwise(LABELS[2]))


def forward_returns(returns: DataFrame, horizons: Sequence[int] = (1, 5, 21), by: Sequence[str] = ("book",)) -> DataFrame:
    """fwd_h: compound return of h rows from the row itself; null where fewer follow."""
    order = Window.partitionBy(*by).orderBy("date")
    frames = {h: order.rowsBetween(0, h - 1) for h in horizons}
    return returns.withColumns({f"fwd_{h}": F.when(F.count("r").over(f) == h, F.product(1 + F.col("r")).over(f) - 1) for h, f in frames.items()})


def bucket_stats(labelled: DataFrame, horizons: Sequence[int] = (1, 5, 21)) -> DataFrame:
    """label, horizon, mean, n; buckets without a value are left out."""
    long = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("x")) for h in horizons]))
    rows = labelled.select("label", long.alias("e")).select("label", "e.*")
    return rows.groupBy("label", "horizon").agg(F.avg("x").alias("mean"), F.count("x").alias("n")).where("n > 0")


#: z-scores of the macro series, in the order in which the principal axis is taken; the first is the anchor of its sign.
Z_NAMES = ("vix_z", "dxy_z", "ief_z", "credit_z")


def rolling_pc1(zs: DataFrame, columns: Sequence[str], anchor: str, name: str = "pca_factor", history: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds to each row its projection (not centred) on the first principal axis of the rows up to it: of all, or of the last `history`.

    The axis has unit length and a loading >= 0 at the anchor. Rows that lack a column count for no covariance and
    have no projection; nor has the first whole row, as one row has no covariance.
    """
    cols, n = list(columns), len(columns)
    order = Window.partitionBy(*by).orderBy("date") if by else Window.partitionBy(F.lit(0)).orderBy("date")
    frame = order.rowsBetween(Window.unboundedPreceding if history is None else 1 - history, 0)
    whole = F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in cols))
    x = {c: F.when(whole, F.col(c)) for c in cols}
    # pairs in the order of the packed upper triangle
    cov = [F.covar_samp(x[a], x[b]).over(frame) for i, a in enumerate(cols) for b in cols[i:]]
    rows = zs.withColumn("_cov", F.when(whole, F.array(*cov)))
    rows = rows.withColumn("_axis", principal_axis(F.col("_cov"), n, cols.index(anchor)))
    dot = sum((F.get("_axis", F.lit(i)) * F.col(c) for i, c in enumerate(cols[1:], 1)), F.get("_axis", F.lit(0)) * F.col(cols[0]))
    return rows.withColumn(name, dot).drop("_cov", "_axis")


def regime_table(prices: DataFrame, window: int = 252, names: dict[str, str] | None = None, weights: ScoreWeights = ScoreWeights(), history: int | None = None) -> DataFrame:
    """One row for each date on which all macro tickers have a price: days (such dates so far), z-scores, pca_factor, score, posteriors,
    policy, label, and unresolved: the inputs that lack history, by name.

    A date with an unresolved input has no score and nothing that follows from it, never that of a neutral market.
    names: the tickers that stand for vix, dxy, hyg and ief; history: rows of z-scores behind the principal axis (all so far).
    """
    names = names or {"vix": "^VIX", "dxy": "UUP", "hyg": "HYG", "ief": "IEF"}
    pick = [F.max(F.when(F.col("ticker") == t, F.col("price"))).alias(k) for k, t in names.items()]
    wide = prices.where(F.col("ticker").isin(list(names.values()))).groupBy("date").agg(*pick).dropna().withColumn("credit", F.col("hyg") / F.col("ief"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # one macro series: a row for each day
    frame = order.rowsBetween(1 - window, 0)

    def z(c: str) -> Column:
        sd = F.stddev_samp(c).over(frame)
        return F.when((F.count(c).over(frame) == window) & (sd > 0), (F.col(c) - F.avg(c).over(frame)) / sd)

    zs = wide.select("date", F.row_number().over(order).alias("days"), *[z(c.removesuffix("_z")).alias(c) for c in Z_NAMES])
    zs = rolling_pc1(zs, Z_NAMES, Z_NAMES[0], history=history)
    known = [*Z_NAMES, "pca_factor"]
    zs = zs.withColumn("unresolved", F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in known]))
    score = composite_score(*[F.col(c) for c in known], w=weights)
    scored = zs.withColumn("score", F.when(F.col("unresolved") == "", score))
    done = label_from_posterior(policy(mixture_posterior(scored)))
    follow = [*(f"posterior_{x}" for x in LABELS), "gross_target", "beta_cap", "label"]
    return done.withColumns({c: F.when(F.col("unresolved") == "", F.col(c)) for c in follow})


def regime_asof(table: DataFrame, asof, window: int = 252) -> DataFrame:
    """The last row of a regime table on or before asof; an error if there is none, or if one of its inputs is unresolved."""
    last = table.where(F.col("date") <= F.lit(asof).cast("date")).agg(F.max_by(F.struct(*table.columns), "date").alias("s"))
    none = F.lit(f"no macro prices up to {asof}")
    short = F.concat(F.lit(f"insufficient macro history for {asof}: "), F.col("s.days").cast("string"), F.lit(f" aligned trading days (need {window}); unresolved: "), F.col("s.unresolved"))
    ok = F.when(F.col("s").isNull(), F.raise_error(none).cast("boolean")).when(F.col("s.unresolved") != "", F.raise_error(short).cast("boolean")).otherwise(True)
    return last.where(ok).select("s.*")


def pc1_score(history: DataFrame, columns: Sequence[str], anchor: str) -> DataFrame:
    """One row, pc1: the projection of the last whole row on the first principal axis of all whole rows; null without any.

    One aggregate: the covariances, the last row and the axis never leave the executors.
    """
    cols, n = list(columns), len(columns)
    rows = history.dropna(subset=cols)
    cov = [F.covar_samp(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = rows.agg(F.array(*cov).alias("cov"), F.max_by(F.array(*[F.col(c).cast("double") for c in cols]), "date").alias("last"))
    axis = principal_axis(F.col("cov"), n, cols.index(anchor))
    dot = F.aggregate(F.zip_with("axis", "last", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return one.withColumn("axis", axis).select(dot.alias("pc1"))
