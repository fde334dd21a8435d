"""Covariances of many books at once against numpy, and eigenvalue clipping."""

import datetime as dt

import numpy as np
import pytest

from ledgerframe.operators import covariance as C, returns as R

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def matrices(spark, by_book):
    rows = [(b, t, u, float(m[i][j])) for b, (ts, m) in by_book.items() for i, t in enumerate(ts) for j, u in enumerate(ts)]
    return spark.createDataFrame(rows, "book string, ticker_i string, ticker_j string, cov double")


def test_clipping_of_each_book_apart(spark):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    bent = q @ np.diag([2.0, 0.5, -0.3]) @ q.T
    skew = np.array([[2.0, 0.2], [0.4, 1.0]])
    got = C.clip_eigenvalues(matrices(spark, {"bent": (("A", "B", "C"), bent), "skew": (("Z", "A"), skew)}), ["book"], 0.01).toPandas()
    wide = lambda b: got[got.book == b].pivot(index="ticker_i", columns="ticker_j", values="cov").to_numpy()
    assert wide("bent") == pytest.approx(q @ np.diag([2.0, 0.5, 0.01]) @ q.T)
    assert wide("skew") == pytest.approx(np.array([[1.0, 0.3], [0.3, 2.0]]))
    assert set(map(tuple, got[["book", "n_clipped"]].drop_duplicates().to_numpy())) == {("bent", 1), ("skew", 0)}


def test_what_is_no_matrix_is_refused(spark):
    whole = matrices(spark, {"b": (("A", "B"), np.eye(2))})
    with pytest.raises(ValueError):
        C.clip_eigenvalues(whole, [])
    for bad in (whole.where("ticker_i = 'A' or ticker_j = 'B'"), whole.replace({1.0: float("nan")}, subset=["cov"])):
        with pytest.raises(Exception, match="not a whole matrix"):
            C.clip_eigenvalues(bad, ["book"]).collect()
    with pytest.raises(Exception):
        C.clip_eigenvalues(whole.union(whole), ["book"]).collect()
    assert C.clip_eigenvalues(whole.limit(0), ["book"]).count() == 0


def test_annualized_covariances(spark):
    rng = np.random.default_rng(6)
    px = {b: np.exp(rng.normal(0, 0.02, (n, 3)).cumsum(axis=0)) for b, n in (("long", 40), ("short", 3), ("one", 2))}
    rows = [(b, t, D[i], float(p[i, j])) for b, p in px.items() for i in range(len(p)) for j, t in enumerate("ABC")]
    got = C.annualized_covariances(spark.createDataFrame(rows, "book string, ticker string, date date, price double"), ["book"]).toPandas()
    for b in ("long", "short"):
        want = C.ensure_psd(np.cov((px[b][1:] / px[b][:-1] - 1).T) * 252)
        assert got[got.book == b].pivot(index="ticker_i", columns="ticker_j", values="cov").to_numpy() == pytest.approx(want, abs=1e-12)
    assert set(got.book) == {"long", "short"} and set(got[got.book == "short"].n_clipped) == {2}


def test_gaps_are_errors_and_whole_dates_have_none(spark):
    rows = [("b", t, D[i], 1.0 + i + j) for i in range(6) for j, t in enumerate("AB") if (i, t) != (3, "B")]
    prices = spark.createDataFrame(rows, "book string, ticker string, date date, price double")
    r = {(x["ticker"], x["date"]): x["r"] for x in R.unpadded_returns(prices, ["book"]).collect()}
    assert len(r) == 10 and r["B", D[3]] is None and r["B", D[4]] is None and r["A", D[3]] == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="no return for b B"):
        C.annualized_covariances(prices, ["book"]).collect()
    kept = R.on_whole_dates(prices, ["book"])
    assert sorted({x["date"] for x in kept.collect()}) == [D[i] for i in (0, 1, 2, 4, 5)]
    assert C.annualized_covariances(kept, ["book"]).count() == 4 and R.on_whole_dates(prices.drop("book")).count() == 10
