"""Rebalancing runs on disk: inputs and results by run id, written so that a repeated write leaves the same rows, and replayed from there.

A run is a set of tables, each in a folder of its own, partitioned by run_id; only the partition of the run written is
overwritten. Its manifest (the number of rows and their digest, a row for each table) is written last, so a run whose
writing broke off between two tables has none, or one that its tables do not match, and is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rebalance as M

#: Format of each table of a run (fixed): inputs as JSON, results as Parquet, what people look at as CSV.
FORMATS = {"accounts": "json", "holdings": "json", "models": "json", "prices": "json", "results": "parquet", "orders": "parquet", "band_table": "csv", "summary": "json"}
MONEY = ("total_value", "post_cash", "notional")


def cents(rows: DataFrame) -> DataFrame:
    """Money to the cent on the way out; the operators themselves do not round."""
    return rows.withColumns({c: F.round(c, 2) for c in MONEY if c in rows.columns})


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, digest of each table: digests of rows are added up, so neither order nor partitioning matters."""
    parts = []
    for name, rows in sorted(tables.items()):
        # as text: files keep numbers to the last digit, but not whether a whole one was a double
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
        digest = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
        parts.append(rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), digest.alias("digest")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _write(rows: DataFrame, path: str, kind: str, run_id: str) -> None:
    writer = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").format(kind)
    (writer.option("header", True) if kind == "csv" else writer).save(path)


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Write the tables of a run (names of FORMATS), then its manifest."""
    if unknown := set(tables) - set(FORMATS):
        raise KeyError(*sorted(unknown))
    for name, rows in tables.items():
        _write(rows, f"{folder}/{name}", FORMATS[name], run_id)
    _write(manifest(tables), f"{folder}/manifest", "json", run_id)


def read_table(spark: SparkSession, folder: str, name: str, run_id: str, schema: str) -> DataFrame:
    """A table of a run, without its run id; schema as DDL, so nothing is inferred."""
    reader = spark.read.schema(schema + ", run_id string").format(FORMATS.get(name, "json"))
    rows = (reader.option("header", True) if FORMATS.get(name) == "csv" else reader).load(f"{folder}/{name}")
    return rows.where(F.col("run_id") == run_id).drop("run_id")


def read_run(spark: SparkSession, folder: str, run_id: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a run by their schemas; an error unless the manifest says that all of them are there and whole."""
    tables = {name: read_table(spark, folder, name, run_id, schema) for name, schema in schemas.items()}
    stored = read_table(spark, folder, "manifest", run_id, "name string, rows long, digest string")
    wrong = manifest(tables).alias("a").join(stored.alias("b"), "name", "left").where("not (a.rows <=> b.rows and a.digest <=> b.digest)").select("name")
    names = [r["name"] for r in wrong.orderBy("name").collect()]  # a row for each table
    if names:
        raise RuntimeError(f"run {run_id} is not whole: {', '.join(names)}")
    return tables


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def replay(accounts: DataFrame, holdings: DataFrame, models: DataFrame, prices: DataFrame, orders: DataFrame, asof, run_id: str, rules: M.Rules = M.Rules(), version: str = "1", most_excluded: float = M.MOST_EXCLUDED) -> DataFrame:
    """One row: whether the stored inputs still have the run's id, and how many stored orders the run from them lacks (missing) or
    has beside them (extra), as multisets with money in cents."""
    again = cents(M.orders_of(M.run(accounts, holdings, models, prices, rules, most_excluded))).select(*orders.columns)
    # one signed count for each order: both differences of the multisets from one pass over either side
    signed = orders.withColumn("_n", F.lit(1)).unionByName(again.withColumn("_n", F.lit(-1))).groupBy(*orders.columns).agg(F.sum("_n").alias("_n"))
    found = signed.agg(F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("extra"))
    ids = M.run_id(accounts, holdings, models, prices, asof, rules, version)
    return ids.crossJoin(found).select("run_id", (F.col("run_id") == run_id).alias("same_id"), "missing", "extra")  # one row each
