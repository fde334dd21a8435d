"""The rolling principal axis against numpy, and the refusal of short histories."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.symmetric import principal_axis
from ledgerframe.operators import regime as G

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]
COLS = ["a", "b", "c"]


def table(spark, x):
    return spark.createDataFrame([(d, *[None if v is None else float(v) for v in row]) for d, row in zip(D, x)], "date date, a double, b double, c double")


def brute(rows, anchor=0):
    x = np.array(rows)
    if len(x) < 2:
        return None
    v = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, -1]
    return float(x[-1] @ (v if v[anchor] >= 0 else -v))


@pytest.mark.parametrize("history", [None, 20])
def test_rolling_pc1_is_numpys(spark, history):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(80, 3)) @ np.array([[1.0, 0.4, -0.7], [0, 1, 0.2], [0, 0, 0.5]])).tolist()
    got = [r["pca_factor"] for r in G.rolling_pc1(table(spark, x), COLS, "a", history=history).orderBy("date").collect()]
    want = [brute(x[max(0, i + 1 - (history or 10**6)) : i + 1]) for i in range(len(x))]
    assert got[0] is None and got[1:] == pytest.approx(want[1:], abs=1e-9)
    assert G.pc1_score(table(spark, x), COLS, "a").first()["pc1"] == pytest.approx(want[-1] if history is None else brute(x), abs=1e-9)


def test_rows_that_lack_a_column(spark):
    x = [(1, 2, 1), (2, 1, 0), (None, 5, 5), (3, 3, 1), (float("nan"), 1, 1), (0, 4, 2)]
    got = [r["pca_factor"] for r in G.rolling_pc1(table(spark, x), COLS, "b").orderBy("date").collect()]
    whole = [x[i] for i in (0, 1, 3, 5)]
    assert got[0] is got[2] is got[4] is None
    assert [got[1], got[3], got[5]] == pytest.approx([brute(whole[:k], 1) for k in (2, 3, 4)], abs=1e-9)
    assert G.pc1_score(table(spark, [(None, 1, 1)]), COLS, "a").first()["pc1"] is None  # no whole row
    assert G.rolling_pc1(table(spark, []), COLS, "a").count() == 0


def test_each_group_has_its_own_axis(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 3)).tolist()
    both = table(spark, x).withColumn("g", F.lit("x")).unionByName(table(spark, [[-3 * r[0], r[2], r[1]] for r in x]).withColumn("g", F.lit("y")))
    got = G.rolling_pc1(both, COLS, "a", by=["g"]).where(F.col("date") == F.lit(D[29])).orderBy("g").collect()
    assert [r["pca_factor"] for r in got] == pytest.approx([brute(x), brute([[-3 * r[0], r[2], r[1]] for r in x])], abs=1e-9)


def test_axis_of_close_eigenvalues_and_of_nothing(spark):
    axis = lambda m, n, anchor: spark.createDataFrame([(m,)], "m array<double>").select(principal_axis(F.col("m"), n, anchor).alias("v")).first()["v"]
    assert axis([1.0 + 1e-6, 0.0, 1.0], 2, 0) == pytest.approx([1, 0], abs=1e-9)
    assert axis([1.0, -0.5, 1.0], 2, 1) == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert axis([1e-200, 0.0, 2e-200], 2, 1) == pytest.approx([0, 1])
    assert axis([0.0, 0.0, 0.0], 2, 0) is None and axis([1.0, None, 1.0], 2, 0) is None and axis([1.0, float("nan"), 1.0], 2, 0) is None


def macro(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    px = np.exp(rng.normal(0, 0.02, (n, 4)).cumsum(axis=0)) * 50
    return spark.createDataFrame([(t, D[i], float(px[i, j])) for i in range(n) for j, t in enumerate(("^VIX", "UUP", "HYG", "IEF"))], "ticker string, date date, price double"), px


def test_a_short_history_has_no_score(spark):
    prices, px = macro(spark, 25)
    rows = G.regime_table(prices, window=20).orderBy("date").collect()
    assert [r["days"] for r in rows] == list(range(1, 26))
    assert rows[18]["unresolved"] == "vix_z, dxy_z, ief_z, credit_z, pca_factor" and rows[19]["unresolved"] == "pca_factor"
    for r in rows[:20]:
        assert r["score"] is r["label"] is r["posterior_risk_on"] is r["gross_target"] is r["beta_cap"] is None
    z = lambda x: (x[-1] - x[-20:].mean()) / x[-20:].std(ddof=1)
    series = [px[:, 0], px[:, 1], px[:, 3], px[:, 2] / px[:, 3]]
    hist = [[z(s[: i + 1]) for s in series] for i in range(19, 25)]
    v, d, i, c = hist[-1]
    pca = brute(hist)
    raw = 50 - 12 * v - 8 * d - 6 * i - 6 * pca - 20 / (1 + np.exp(-1.2 * v)) + (5 * c if c >= 0 else -15 * abs(c))
    assert rows[-1]["pca_factor"] == pytest.approx(pca, abs=1e-9) and rows[-1]["score"] == pytest.approx(min(100, max(0, raw)), abs=1e-8)


def test_asof_refuses(spark):
    table = G.regime_table(macro(spark, 25)[0], window=20)
    assert G.regime_asof(table, "2030-01-01", 20).first()["date"] == D[24]
    with pytest.raises(Exception, match=r"insufficient macro history for 2024-01-10: 10 aligned trading days \(need 20\); unresolved: vix_z"):
        G.regime_asof(table, "2024-01-10", 20).count()
    with pytest.raises(Exception, match="no macro prices up to 2020-01-01"):
        G.regime_asof(table, "2020-01-01", 20).count()
