"""Task cells: samples collapsed to one outcome, direction pairs, and leave-one-out variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The statistical unit.
CELL = ("model", "suite", "kernel", "direction")


def any_sample(df: DataFrame, key: tuple[str, ...] = CELL) -> DataFrame:
    """AGG-04: a cell passes if any of its records does. One partial aggregation, one shuffle by the key."""
    return df.groupBy(*key).agg(F.bool_or("passed").alias("passed"), F.count("*").alias("n"), F.count_if("passed").alias("c"))


def paired(cells: DataFrame, forward: str, backward: str) -> DataFrame:
    """JOI-06: cells of a direction with those of its reverse, on (model, suite, kernel)."""
    on = ["model", "suite", "kernel"]
    side = lambda x, name: cells.where(F.col("direction") == x).select(*on, F.col("passed").alias(name))
    return side(forward, "forward").join(side(backward, "backward"), on)


def all_pairs(cells: DataFrame) -> DataFrame:
    """Every cell with its reverse at once: one self-join on (model, suite, kernel, unordered pair of APIs)."""
    a, b = F.substring_index("direction", "-to-", 1), F.substring_index("direction", "-to-", -1)
    keyed = cells.withColumn("pair", F.concat_ws("/", F.least(a, b), F.greatest(a, b))).withColumn("first", a < b)
    on = ["model", "suite", "kernel", "pair"]
    return keyed.groupBy(*on).agg(F.bool_or(F.when(F.col("first"), F.col("passed"))).alias("forward"), F.bool_or(F.when(~F.col("first"), F.col("passed"))).alias("backward")).where("forward is not null and backward is not null")


def leave_one_out(df: DataFrame, by: str, measures: dict) -> DataFrame:
    """AGG-12: the measures over all rows (variant FULL) and without each value of ``by``.

    Rows are aggregated to one for each value first; a variant is the sum of these few less the one left out.
    ``measures`` maps names to count or sum columns.
    """
    parts = df.groupBy(by).agg(*[m.alias(k) for k, m in measures.items()])
    every = Window.partitionBy()  # as many rows as values
    variants = parts.withColumn("_values", F.count("*").over(every)).select(F.concat(F.lit("minus_"), by).alias("variant"), "_values", *[(F.sum(k).over(every) - F.col(k)).alias(k) for k in measures])
    full = parts.agg(F.lit("FULL").alias("variant"), F.count("*").alias("_values"), *[F.sum(k).alias(k) for k in measures]).where("_values > 0")
    return variants.where("_values > 1").unionByName(full).drop("_values")
