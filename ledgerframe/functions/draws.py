"""Random numbers that are a function of seed and counters, so a draw is the same whatever task makes it and however often.

A number is the orbit of x -> x * x + c (mod 2**31 - 1), with a counter added in each step: whole
numbers below 2**62 throughout, which any SQL engine repeats to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Modulus, factors of seed and counters, addend, and the steps after the last counter (fixed values: results hang on them).
MODULUS, SEED_FACTOR, COUNTER_FACTOR, ADDEND, LAST_STEPS = 2147483647, 48271, 16807, 12345, 2


def with_uniform(rows: DataFrame, name: str, counters: list[Column | str | int], seed: int) -> DataFrame:
    """The rows with a number between 0 and 1 (both excluded) that depends on the seed and the counters (whole numbers below 10**9)."""
    x = F.lit((seed * SEED_FACTOR + 1) % MODULUS).cast("long")
    for c in [*counters, *[0] * LAST_STEPS]:
        c = F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c
        # a column for each step: each value is squared where it stands, not worked out twice
        rows = rows.withColumn(name, (x * x + c.cast("long") * COUNTER_FACTOR + ADDEND) % MODULUS)
        x = F.col(name)
    return rows.withColumn(name, (x + 0.5) / MODULUS)


def with_uniforms(rows: DataFrame, name: str, counters: list[str], size: Column, seed: int) -> DataFrame:
    """The rows with an array of `size` such numbers, whose last counter is their place (from 1): what with_uniform gives for a row for each place."""
    x = F.lit((seed * SEED_FACTOR + 1) % MODULUS).cast("long")
    for c in counters:
        rows = rows.withColumn(name, (x * x + F.col(c).cast("long") * COUNTER_FACTOR + ADDEND) % MODULUS)
        x = F.col(name)
    numbers = F.transform(F.sequence(F.lit(1).cast("long"), size.cast("long")), lambda j: (x * x + j * COUNTER_FACTOR + ADDEND) % MODULUS)
    for _ in range(LAST_STEPS):
        numbers = F.transform(numbers, lambda y: (y * y + ADDEND) % MODULUS)
    return rows.withColumn(name, F.transform(numbers, lambda y: (y + 0.5) / MODULUS))


def with_uniform_sql(source: str, name: str, counters: list[str | int], seed: int) -> str:
    """The same as a SELECT over the relation or subquery `source`."""
    first = (seed * SEED_FACTOR + 1) % MODULUS
    steps = [*counters, *[0] * LAST_STEPS]
    sql = f"SELECT *, (CAST({first} AS BIGINT) * {first} + {steps[0]} * {COUNTER_FACTOR} + {ADDEND}) % {MODULUS} AS {name} FROM {source}"
    for c in steps[1:]:
        sql = f"SELECT * REPLACE (({name} * {name} + {c} * {COUNTER_FACTOR} + {ADDEND}) % {MODULUS} AS {name}) FROM ({sql})"
    return f"SELECT * REPLACE (({name} + 0.5) / {MODULUS} AS {name}) FROM ({sql})"


def quantile_ranks(size: int, p: float) -> tuple[int, int, float]:
    """Places (from 0) of the two order statistics of `size` values between which the quantile lies, and how far."""
    at = (size - 1) * p
    return int(at), min(size - 1, int(at) + 1), at - int(at)


def resampled_ranks(spark: SparkSession, pool: int, size: int, n: int, p: float, seed: int) -> DataFrame:
    """draw, low, high: for each of n resamples (`size` of `pool` places, with replacement) the places in the sorted pool between which its
    quantile lies. Resamples are drawn as places, so the pool itself is never copied."""
    low, high, _ = quantile_ranks(size, p)
    places = with_uniforms(spark.range(1, n + 1).withColumnRenamed("id", "draw"), "_u", ["draw"], F.lit(size), seed)
    ordered = places.select("draw", F.sort_array(F.transform("_u", lambda u: F.floor(u * pool).cast("int"))).alias("_a"))
    return ordered.select("draw", F.get("_a", F.lit(low)).alias("low"), F.get("_a", F.lit(high)).alias("high"))


def resampled_ranks_sql(pool: str, size: str, n: int, p: float, seed: int) -> str:
    """The same as a SELECT; pool and size are numbers or columns of the relation that it stands beside."""
    places = with_uniform_sql(f"(SELECT draw, unnest(generate_series(1, {size})) AS j FROM (SELECT unnest(generate_series(1, {n})) AS draw))", "u", ["draw", "j"], seed)
    at = f"(({size} - 1) * CAST({p} AS DOUBLE))"
    return f"SELECT draw, a[CAST(floor({at}) AS BIGINT) + 1] AS low, a[CAST(least({size} - 1, floor({at}) + 1) AS BIGINT) + 1] AS high FROM (SELECT draw, list_sort(list(CAST(floor(u * {pool}) AS BIGINT))) AS a FROM ({places}) GROUP BY draw)"
