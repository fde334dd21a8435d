"""Covariances as rows (ticker_i, ticker_j, cov), model comparison, and small numerical kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.checks import require_known
from .returns import unpadded_returns


def sample_covariance(returns: DataFrame, scale: float = 1.0) -> DataFrame:
    """Both triangles of the sample covariance over the dates of (ticker, date, r)."""
    i = returns.select("date", F.col("ticker").alias("ticker_i"), F.col("r").alias("ri"))
    j = returns.select("date", F.col("ticker").alias("ticker_j"), F.col("r").alias("rj"))
    half = i.join(j, "date").where("ticker_i <= ticker_j").groupBy("ticker_i", "ticker_j").agg((F.covar_samp("ri", "rj") * scale).alias("cov"))
    return half.union(half.where("ticker_i < ticker_j").select("ticker_j", "ticker_i", "cov"))


def covariances(returns: DataFrame, by: Sequence[str], scale: float = 1.0) -> DataFrame:
    """by, ticker_i, ticker_j, cov: both triangles of the sample covariance of every group of (by, date, ticker, r), each over its own dates.

    A missing return is an error (dates are to be aligned first); groups with fewer than two dates have no covariance and no rows.
    """
    by = list(by)
    gap = F.raise_error(F.concat_ws(" ", F.lit("no return for"), *[F.col(c).cast("string") for c in [*by, "ticker", "date"]]))
    # the guarded value is what is multiplied: nothing joined later can take its row away before
    rows = returns.withColumn("r", F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.col("r")).otherwise(gap.cast("double")))
    i = rows.select(*by, "date", F.col("ticker").alias("ticker_i"), F.col("r").alias("ri"))
    j = rows.select(*by, "date", F.col("ticker").alias("ticker_j"), F.col("r").alias("rj"))
    half = i.join(j, [*by, "date"]).where("ticker_i <= ticker_j").groupBy(*by, "ticker_i", "ticker_j").agg((F.covar_samp("ri", "rj") * scale).alias("cov")).where("cov is not null")
    swap = F.when(F.col("ticker_i") < F.col("ticker_j"), F.array(F.struct("ticker_i", "ticker_j"), F.struct(F.col("ticker_j").alias("ticker_i"), F.col("ticker_i").alias("ticker_j")))).otherwise(F.array(F.struct("ticker_i", "ticker_j")))
    return half.select(*by, F.explode(swap).alias("x"), "cov").select(*by, "x.ticker_i", "x.ticker_j", "cov")


def clip_eigenvalues(cov: DataFrame, by: Sequence[str], floor: float = 1e-10) -> DataFrame:
    """by, ticker_i, ticker_j, cov, n_clipped: the covariances of every group made symmetric, eigenvalues below `floor` raised to it.

    A matrix is one group (tickers squared rows), so groups go over the tasks; without `by` there would be one group for
    all rows, which is refused. A missing or not finite entry, or a repeated one, is an error.
    """
    import pandas as pd

    by = list(by)
    if not by:
        raise ValueError("clip_eigenvalues needs the columns that tell matrices apart")
    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def clip(key, pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = pdf.pivot(index="ticker_i", columns="ticker_j", values="cov").sort_index().sort_index(axis=1)
        c = matrix.to_numpy(dtype=float)
        if list(matrix.index) != list(matrix.columns) or not np.isfinite(c).all():
            raise ValueError(f"covariances of {key} are not a whole matrix")
        n = int((np.linalg.eigvalsh((c + c.T) / 2) < floor).sum())
        c = ensure_psd(c, floor) if n else (c + c.T) / 2
        names = matrix.index.to_numpy()
        return pd.DataFrame({**dict(zip(by, key)), "ticker_i": np.repeat(names, len(names)), "ticker_j": np.tile(names, len(names)), "cov": ((c + c.T) / 2).ravel(), "n_clipped": n})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "ticker_i string", "ticker_j string", "cov double", "n_clipped long"])
    return cov.select(*by, "ticker_i", "ticker_j", "cov").groupBy(*by).applyInPandas(clip, schema)


def annualized_covariances(prices: DataFrame, by: Sequence[str], periods: int = 252, floor: float = 1e-10) -> DataFrame:
    """Positive semidefinite covariances of unpadded daily returns times `periods`, for every group of (by, ticker, date, price)."""
    return clip_eigenvalues(covariances(unpadded_returns(prices, by), by, periods), by, floor)


def factor_model_covariance(betas: DataFrame, factor_cov: DataFrame, resid: DataFrame) -> DataFrame:
    """B F B' + diag(D): betas (ticker, factor, beta), factor_cov (factor_i, factor_j, cov), resid (ticker, resid_var)."""
    left = betas.select(F.col("ticker").alias("ticker_i"), F.col("factor").alias("factor_i"), F.col("beta").alias("bi"))
    right = betas.select(F.col("ticker").alias("ticker_j"), F.col("factor").alias("factor_j"), F.col("beta").alias("bj"))
    common = left.join(factor_cov, "factor_i").join(right, "factor_j").groupBy("ticker_i", "ticker_j").agg(F.sum(F.col("bi") * F.col("cov") * F.col("bj")).alias("common"))
    own = resid.select(F.col("ticker").alias("ticker_i"), F.col("ticker").alias("ticker_j"), "resid_var")
    return common.join(own, ["ticker_i", "ticker_j"], "left").select("ticker_i", "ticker_j", (F.col("common") + F.coalesce("resid_var", F.lit(0.0))).alias("cov"))


def tracking_error(weights: DataFrame, reference: DataFrame, cov: DataFrame) -> DataFrame:
    """sqrt(d' cov d) of the weight differences over the tickers of either side; one without a covariance is an error."""
    d = weights.select("ticker", F.col("weight").alias("w")).join(reference.select("ticker", F.col("weight").alias("v")), "ticker", "full")
    d = d.select("ticker", (F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))).alias("d"))
    d = require_known(d, cov.select(F.col("ticker_i").alias("ticker")), "ticker", "no covariance for")
    q = cov.join(d.select(F.col("ticker").alias("ticker_i"), F.col("d").alias("di")), "ticker_i").join(d.select(F.col("ticker").alias("ticker_j"), F.col("d").alias("dj")), "ticker_j")
    return q.agg(F.sqrt(F.greatest(F.sum(F.col("di") * F.col("cov") * F.col("dj")), F.lit(0.0))).alias("te"))


def compare_models(old: DataFrame, new: DataFrame, sleeves: DataFrame | None = None, threshold: float = 0.0005) -> DataFrame:
    """ticker (and sleeve), old, new, diff, changed."""
    both = old.select("ticker", F.col("weight").alias("old")).join(new.select("ticker", F.col("weight").alias("new")), "ticker", "full").fillna(0.0, ["old", "new"])
    out = both.withColumn("diff", F.col("new") - F.col("old")).withColumn("changed", F.abs(F.col("new") - F.col("old")) > threshold)
    return out if sleeves is None else out.join(sleeves, "ticker", "left")


def model_change(comparison: DataFrame, aum: float) -> DataFrame:
    """One row: one-way turnover, number of changes, dollars bought and sold."""
    up, down = F.greatest(F.col("diff"), F.lit(0.0)), F.greatest(-F.col("diff"), F.lit(0.0))
    return comparison.agg((F.sum(F.abs("diff")) / 2).alias("turnover"), F.sum(F.col("changed").cast("long")).alias("n_changed"), (F.sum(up) * aum).alias("bought"), (F.sum(down) * aum).alias("sold"))


def round_to_grid(weights: DataFrame, step: float, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Largest remainder: whole steps of the weights (negative ones count as 0), the missing ones to the largest remainders, ties in ticker order.

    1 / step must be a whole number, and weights of a group that do not sum to 1 (within 1e-6) are an error.
    """
    units = round(1 / step)
    if abs(units * step - 1) > 1e-9:
        raise ValueError(f"1 / {step} is not a whole number")
    group = Window.partitionBy(*by)
    total = F.sum("weight").over(group)
    off = F.raise_error(F.concat_ws(" ", F.lit("weights do not sum to 1:"), *[F.col(c).cast("string") for c in by], F.col("_total").cast("string")))
    rows = weights.withColumn("_total", total).where(F.when(F.abs(F.col("_total") - 1) <= 1e-6, True).otherwise(off.cast("boolean")))
    scaled = F.greatest(F.col("weight"), F.lit(0.0)) * units
    rows = rows.withColumn("_f", F.floor(scaled + F.lit(1e-9))).withColumn("_rem", scaled - F.col("_f"))
    left = F.lit(units) - F.sum("_f").over(group)
    nr = F.row_number().over(group.orderBy(F.desc("_rem"), "ticker"))
    rows = rows.withColumn("_left", left).withColumn("_nr", nr)
    return rows.withColumn("rounded", (F.col("_f") + (F.col("_nr") <= F.col("_left")).cast("int")) / F.lit(units)).drop("_total", "_f", "_rem", "_left", "_nr")


def ensure_psd(cov: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Symmetric matrix with eigenvalues of at least floor."""
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    return (vector * np.maximum(value, floor)) @ vector.T


def min_variance(cov: np.ndarray, start: np.ndarray | None = None, alpha: np.ndarray | None = None, turnover_cost: float = 0.0, reward: float = 0.0, net: float = 1.0, bound: float = 1.0, gross: float = np.inf, rounds: int = 20000, tolerance: float = 1e-10) -> np.ndarray:
    """min w'Cw + cost |w - start|_1 - reward alpha'w with sum w = net, |w_i| <= bound, |w|_1 <= gross.

    Small dense problems, by the alternating direction method on w = z, z in the box and the l1 terms.
    """
    n = len(cov)
    start = np.zeros(n) if start is None else start
    if bound * n < abs(net) - 1e-12 or gross < abs(net) - 1e-12:
        raise ValueError("no weights meet the constraints")
    q = -reward * (np.zeros(n) if alpha is None else alpha)
    rho = max(1e-3, 2 * float(np.trace(cov)) / n)
    kkt = np.block([[2 * ensure_psd(cov) + 2 * rho * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solve = np.linalg.inv(kkt)
    z, g, u, v = start.copy(), np.clip(np.full(n, net / n), -bound, bound), np.zeros(n), np.zeros(n)
    w = g
    for _ in range(rounds):
        w = (solve @ np.append(-q + rho * (z - u) + rho * (g - v), net))[:n]
        d = w + u - start  # turnover term
        z_new = start + np.sign(d) * np.maximum(np.abs(d) - turnover_cost / rho, 0)
        g_new = project(w + v, bound, gross)
        u, v = u + w - z_new, v + w - g_new
        moved = max(np.abs(z_new - z).max(), np.abs(g_new - g).max(), np.abs(w - z_new).max(), np.abs(w - g_new).max())
        z, g = z_new, g_new
        if moved < tolerance:
            break
    else:
        raise RuntimeError("the optimisation did not settle")
    return g


def project(x: np.ndarray, bound: float, gross: float) -> np.ndarray:
    """Nearest point with |x_i| <= bound and sum |x_i| <= gross."""
    y = np.clip(x, -bound, bound)
    if np.abs(y).sum() <= gross:
        return y
    lo, hi = 0.0, float(np.abs(x).max())
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.clip(np.abs(x) - mid, 0, bound).sum() > gross:
            lo = mid
        else:
            hi = mid
    return np.sign(x) * np.clip(np.abs(x) - hi, 0, bound)


def optimise(cov: DataFrame, by: Sequence[str] = ("book",), **rules) -> DataFrame:
    """Weights of least variance for every book's covariance rows (book, ticker_i, ticker_j, cov)."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in cov.schema.fields}

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="ticker_i", columns="ticker_j", values="cov").sort_index().sort_index(axis=1)
        w = min_variance(c.to_numpy(), **rules)
        return pd.DataFrame({**dict(zip(by, key)), "ticker": c.index, "weight": w, "risk": float(np.sqrt(w @ c.to_numpy() @ w))})

    return cov.groupBy(*by).applyInPandas(solve, ", ".join([*(f"{c} {kinds[c]}" for c in by), "ticker string", "weight double", "risk double"]))
