"""Reading the given tables and the domain tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_panel(spark: SparkSession, sf_dir: str, window: int = 60) -> DataFrame:
    """ticker, date, price: value per piece over the last `window` shipping days of each part type.

    Cents are summed as integers and divided once, so the result does not depend on the order of summation.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    daily = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_type").alias("ticker"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    )
    order = Window.partitionBy("ticker").orderBy("date")
    trailing = order.rowsBetween(1 - window, 0)
    rolled = daily.select("ticker", "date", F.sum("cents").over(trailing).alias("s"), F.sum("n").over(trailing).alias("m"), F.row_number().over(order).alias("rn"))
    return rolled.where(F.col("rn") >= window).select("ticker", "date", (F.col("s").cast("double") / (F.col("m").cast("double") * 100000.0)).alias("price"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, model_id, cash: one account for each customer, the model by market segment."""
    model = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "GROWTH").when(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"), "INCOME").otherwise("UNLISTED")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), model.alias("model_id"), F.col("c_acctbal").alias("cash"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, ticker, shares: what the customers' orders hold of each part type."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("account_id"), F.col("p_type").alias("ticker"))
        .agg(F.sum(F.col("l_quantity").cast("double")).alias("shares"))
    )


def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pf_name, experiment_id (null for one segment), branch, source, trade_date, ticker, weight by month."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    cents = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("c_mktsegment").alias("pf_name"), F.trunc(F.to_date("o_orderdate"), "month").alias("trade_date"), F.col("p_type").alias("ticker"))
        .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    )
    total = F.sum("cents").over(Window.partitionBy("pf_name", "trade_date"))
    experiment = F.when(F.col("pf_name") != "BUILDING", F.concat(F.lit("exp-"), F.lower("pf_name")))
    return cents.select("pf_name", experiment.alias("experiment_id"), F.lit(None).cast("string").alias("branch"), F.lit(None).cast("string").alias("source"), "trade_date", "ticker", (F.col("cents") / total).alias("weight"))


def factor_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Betas (ticker, factor, asof_date, lookback, version, loaded, beta) and residual variances (ticker, asof_date, lookback, method, loaded,
    resid_var) of part types by shipping year; loaded tells several writes of one row apart."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_linenumber", "l_discount", "l_tax")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("ticker"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("asof_date", F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)))
    betas = rows.groupBy("ticker", F.col("l_returnflag").alias("factor"), "asof_date", F.col("l_linenumber").alias("loaded")).agg((F.avg("l_discount") * 20).alias("beta"))
    resid = rows.groupBy("ticker", "asof_date", F.col("l_linenumber").alias("loaded")).agg(F.var_samp("l_tax").alias("resid_var"))
    return betas.select("*", F.lit(252).alias("lookback"), F.lit("v1").alias("version")), resid.select("*", F.lit(252).alias("lookback"), F.lit("ewma").alias("method"))
