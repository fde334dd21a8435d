"""The band table: each band's row is that of a run with this band, and folds and holdings are not repeated for the bands."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import rebalance as M
from ledgerframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_each_band_is_a_run_of_its_own(spark):
    rows = Q.QUERIES["band_table"](spark, SF).collect()
    pos = M.valid_positions(*Q.book(spark, SF)).cache()
    assert sorted(r["band"] for r in rows) == list(Q.BANDS)
    for r in rows:
        one = M.rebalanced(pos, M.Rules(band=r["band"]))
        traded = F.col("status") == "TRADED"
        want = one.agg(F.count("*"), F.count_if(traded), F.count_if(F.col("status") == "EXC_TOO_SMALL"), F.sum(F.when(traded, F.col("n_orders")).otherwise(0)), F.percentile(F.when(traded, F.col("drift_after")), F.lit(0.5))).first()
        assert (r["accounts"], r["traded"], r["too_small"], r["orders"]) == tuple(want)[:4]
        assert r["median_drift"] == pytest.approx(want[4] or 0.0, abs=1e-7)


def test_holdings_are_read_once_and_bands_come_last(spark):
    plan = Q.QUERIES["band_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[o_orderkey", plan)) == 1
    # no fold stands above the place where bands are dealt
    at = plan.index("Generate explode")
    assert "lambda" not in plan[:at] and "lambda" in plan[at:]


def test_valid_positions_are_those_of_validate_and_positions(spark):
    a, h, m, p = Q.book(spark, SF)
    got, want = M.valid_positions(a, h, m, p), M.positions(M.validate(a, h, m, p).where("reason is null"), h, m, p)
    columns = ["account_id", "model_id", "cash", "p"]
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty() and got.count() == want.count() > 0
    with pytest.raises(Exception, match="no usable price for"):
        M.valid_positions(a.withColumn("account_id", F.col("account_id") + 10**6), h, m, p.where("false")).collect()  # accounts that hold nothing
