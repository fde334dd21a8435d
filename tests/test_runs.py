"""Runs on disk: written twice, broken off, replayed."""

import pytest

from ledgerframe.operators import rebalance as M
from ledgerframe.sources import runs as S


def test_runs_are_written_read_and_replayed(spark, tmp_path):
    acc = spark.createDataFrame([(1, "m", 100.0), (2, "m", 100.0)], "account_id long, model_id string, cash double")
    held = spark.createDataFrame([(1, "A", 3.0)], "account_id long, ticker string, shares double")
    mod = spark.createDataFrame([("m", "A", 0.5), ("m", "B", 0.5)], "model_id string, ticker string, weight double")
    px = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "ticker string, price double")
    inputs, folder = {"accounts": acc, "holdings": held, "models": mod, "prices": px}, str(tmp_path / "runs")
    run_id = M.run_id(*inputs.values(), "2024-01-01").first()["run_id"]
    orders = spark.createDataFrame(S.cents(M.orders_of(M.run(*inputs.values()))).collect(), "account_id long, ticker string, shares double, side string, price double, notional double")
    tables = inputs | {"orders": orders}
    schemas = {name: S.schema_of(rows) for name, rows in tables.items()}
    S.write_run({"orders": orders.limit(1)}, folder, "other")
    for _ in range(2):  # a repeated write leaves the same rows, and another run alone
        S.write_run(tables, folder, run_id)
    stored = S.read_run(spark, folder, run_id, schemas)
    assert all(stored[n].exceptAll(tables[n]).isEmpty() and tables[n].exceptAll(stored[n]).isEmpty() for n in tables)
    assert S.read_table(spark, folder, "orders", "other", schemas["orders"]).count() == 1
    changed = stored["orders"].replace({orders.first()["shares"]: 999.0}, subset=["shares"])
    bad = S.replay(*[stored[n] for n in inputs], changed, "2024-01-01", run_id).first()
    assert bad["same_id"] and bad["missing"] == bad["extra"] >= 1
    S._write(orders.limit(1), f"{folder}/orders", "parquet", run_id)  # broken off: the table is not that of the manifest
    with pytest.raises(RuntimeError, match="not whole: orders"):
        S.read_run(spark, folder, run_id, schemas)
