"""Registered queries of the subpackage against their SQL on whole tables."""

import os

import duckdb
import pytest

from ledgerframe.llm import queries as Q

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    result = con.execute(Q.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == columns
    got = df.select(*columns).toPandas().sort_values(columns).reset_index(drop=True)
    want = result.df()[columns].sort_values(columns).reset_index(drop=True)
    assert len(got) == len(want) and (got.astype(str) == want.astype(str)).all().all()
