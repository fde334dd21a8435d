"""Model checks, edits, what a change does, and the report of a run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import models as D, rebalance as M

SCHEMA = "model_id string, version string, ticker string, weight double"


def table(spark, models):
    return spark.createDataFrame([(m, "1", t, None if w is None else float(w)) for m, ws in models.items() for t, w in ws], SCHEMA)


def reasons(df):
    return {r["model_id"]: r["reason"] for r in df.collect()}


def test_problems_name_every_bad_model(spark):
    nan, inf = float("nan"), float("inf")
    m = table(spark, {"ok": [("A", 0.5), ("B", 0.5)], "zero": [("A", 1), ("B", 0)], "close": [("A", 0.5), ("B", 0.5 + 5e-10)], "neg": [("B", 1.5), ("A", -0.5)], "nan": [("A", nan), ("B", 1)], "inf": [("B", inf), ("A", -inf)], "null": [("A", None), ("B", 1)], "more": [("A", 0.7), ("B", 0.7)], "less": [("A", 0.5)]})
    listed = spark.createDataFrame([("ok",), ("gone",)], "model_id string")
    named = "negative or non-finite weights: "
    assert reasons(D.problems(m)) == {"neg": named + "A", "nan": named + "A", "inf": named + "A, B", "null": named + "A", "more": "weights sum to 1.4, not 1", "less": "weights sum to 0.5, not 1"}
    assert reasons(D.problems(m, listed)) == {"gone": "empty model"}
    assert D.problems(m.limit(0)).count() == 0 and D.require_valid(m.limit(0)).count() == 0


def test_no_bad_model_is_traded(spark):
    acc = spark.createDataFrame([(1, "m", 100.0)], "account_id long, model_id string, cash double")
    held = spark.createDataFrame([(1, "A", 3.0)], "account_id long, ticker string, shares double")
    px = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "ticker string, price double")
    bad = table(spark, {"m": [("A", 0.7), ("B", 0.7)]})
    for made in (M.run, M.rebalance, M.run_summary):
        with pytest.raises(Exception, match="m: weights sum to 1.4, not 1"):
            made(acc, held, bad, px).count()
            made(acc, held, bad, px).collect()
    with pytest.raises(Exception, match="m: negative or non-finite weights: B"):
        M.orders_of(M.run(acc, held, table(spark, {"m": [("A", 1.5), ("B", -0.5)]}), px)).collect()


def edited(spark, models, edits):
    return D.apply_edits(table(spark, models), spark.createDataFrame(edits, "model_id string, edit string"))


def test_edits_move_weight(spark):
    models = {"m": [("A", 0.6), ("B", 0.4)], "n": [("A", 0.5), ("B", 0.5)], "untouched": [("A", 1)]}
    got = {(r["model_id"], r["ticker"]): (r["version"], r["weight"]) for r in edited(spark, models, [("m", "A:C:0.1"), ("n", "A:B:0.5")]).collect()}
    assert {k: v[0] for k, v in got.items()} == {("m", "A"): "1+A->C", ("m", "B"): "1+A->C", ("m", "C"): "1+A->C", ("n", "B"): "1+A->B"}
    assert [got[k][1] for k in sorted(got)] == pytest.approx([0.5, 0.4, 0.1, 1.0])
    same = edited(spark, models, [("m", "A:A:0.2")]).collect()
    assert {r["ticker"]: r["weight"] for r in same} == pytest.approx({"A": 0.6, "B": 0.4})
    assert edited(spark, models, []).count() == 0


@pytest.mark.parametrize("edit,message", [
    ("A:B", "must look like FROM:TO:SIZE"), ("A:B:x", "must look like FROM:TO:SIZE"), ("A:B:0.1:", "must look like FROM:TO:SIZE"), (None, "must look like FROM:TO:SIZE"),
    ("A:B:0.7", "m holds 0.6 of A and cannot give 0.7"), ("C:B:0.1", "m holds 0.0 of C and cannot give 0.1"), ("A:B:-0.5", "m: weights sum to"), ("A:B:nan", "m"),
])
def test_edits_that_are_refused(spark, edit, message):
    with pytest.raises(Exception, match=message):
        edited(spark, {"m": [("A", 0.6), ("B", 0.4)]}, [("m", edit)]).collect()


def test_edits_of_no_model_and_of_one_model_twice(spark):
    with pytest.raises(Exception, match="no model: x"):
        edited(spark, {"m": [("A", 1)]}, [("x", "A:B:0.1")]).count()
    with pytest.raises(Exception, match="several edits of m"):
        edited(spark, {"m": [("A", 1)]}, [("m", "A:B:0.1"), ("m", "A:C:0.1")]).count()


def test_change_against_numpy(spark):
    rng = np.random.default_rng(2)
    tickers = list("ABCDE")
    c = np.cov(rng.normal(size=(5, 40)))
    cov = spark.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(tickers) for j, b in enumerate(tickers)], "ticker_i string, ticker_j string, cov double")
    old = {"m": [("A", 0.5), ("B", 0.5)], "n": [("B", 0.2), ("C", 0.8)]}
    new = {"m": [("A", 0.3), ("B", 0.5), ("D", 0.2)], "n": [("B", 0.2003), ("C", 0.7997)]}
    bench = {"m": [("E", 0.9), ("A", 0.1)], "other": [("A", 1)]}
    got = {r["model_id"]: r for r in D.change_summary(table(spark, old), table(spark, new), cov, table(spark, bench)).collect()}
    vec = lambda w: np.array([dict(w).get(t, 0.0) for t in tickers])
    te = lambda a, b: float(np.sqrt((vec(a) - vec(b)) @ c @ (vec(a) - vec(b))))
    assert sorted(got) == ["m", "n"] and got["n"]["te_old_bench"] is got["n"]["te_new_bench"] is None
    m = got["m"]
    assert (m["turnover"], m["n_changed"]) == (pytest.approx(0.2), 2) and (got["n"]["turnover"], got["n"]["n_changed"]) == (pytest.approx(0.0003), 0)
    assert (m["te_old_new"], m["te_old_bench"], m["te_new_bench"]) == pytest.approx((te(old["m"], new["m"]), te(old["m"], bench["m"]), te(new["m"], bench["m"])))
    assert got["n"]["te_old_new"] == pytest.approx(te(old["n"], new["n"]))
    with pytest.raises(Exception, match="no covariance for: D"):
        D.change_summary(table(spark, old), table(spark, new), cov.where("ticker_i <> 'D' and ticker_j <> 'D'")).collect()


def test_sleeves_of_a_change(spark):
    old, new = table(spark, {"m": [("A", 0.5), ("B", 0.5)]}), table(spark, {"m": [("A", 0.3), ("C", 0.7)]})
    sleeve = spark.createDataFrame([("A", "s"), ("B", "s"), ("C", "t")], "ticker string, sleeve string")
    rows = {r["sleeve"]: (r["diff"], r["flow"]) for r in D.change_by_sleeve(old, new, sleeve, 1000.0).collect()}
    assert rows["s"] == pytest.approx((-0.7, -700)) and rows["t"] == pytest.approx((0.7, 700))
    assert D.change_by_sleeve(old, new, sleeve).first()["flow"] is None
    with pytest.raises(Exception, match="no sleeve for: C"):
        D.change_by_sleeve(old, new, sleeve.where("ticker <> 'C'")).count()


def test_report_of_a_run(spark):
    acc = spark.createDataFrame([(1, "m", 100.0), (2, "m", 0.0), (3, "n", 100.0), (4, "m", -1.0)], "account_id long, model_id string, cash double")
    held = spark.createDataFrame([(2, "A", 3000.0), (2, "B", 1500.0)], "account_id long, ticker string, shares double")
    px = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "ticker string, price double")
    result = M.run(acc, held, table(spark, {"m": [("A", 0.5), ("B", 0.5)]}), px, most_excluded=1.0)
    rows = {(r["level"], r["status"], r["model_id"], r["size"]): r for r in M.run_report(result).collect()}
    everything = rows[7, None, None, None]
    assert (everything["accounts"], everything["traded"], everything["in_band"], everything["failed"]) == (4, 1, 1, 2)
    assert everything["book_value"] == pytest.approx(60100) and rows[6, None, None, "25k-100k"]["in_band"] == 1 and rows[6, None, None, None]["accounts"] == 2
    orders = M.orders_of(result).agg(F.count("*").alias("n"), F.sum(F.abs("notional")).alias("gross")).first()
    assert (everything["orders"], everything["gross_notional"]) == (orders["n"], pytest.approx(orders["gross"]))
    assert everything["book_turnover"] == pytest.approx(orders["gross"] / 2 / 60100)
    for level, in {(k[0],) for k in rows}:
        assert sum(r["accounts"] for k, r in rows.items() if k[0] == level) == 4


def test_guards_hold_against_filters_inferred_from_later_joins(spark):
    """A filter on the key of the known table must not take away the rows that the guard is there for."""
    from ledgerframe.functions.checks import require_known

    rows = spark.createDataFrame([("A", 1.0), ("D", 2.0)], "ticker string, x double")
    known = spark.createDataFrame([("A", 3.0), ("D", 4.0)], "ticker string, y double").where("ticker <> 'D'")
    with pytest.raises(Exception, match="not there: D"):
        require_known(rows, known, "ticker", "not there").join(known, "ticker").collect()
    with pytest.raises(Exception, match="not there: D"):
        require_known(rows, known, "ticker", "not there").join(known, "ticker").agg(F.sum("y")).collect()
    assert require_known(rows.where("x < 2"), known, "ticker", "not there").join(known, "ticker").count() == 1
