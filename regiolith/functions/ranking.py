"""Argmax, top-k, first occurrence, folds and renumbering, as column and frame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.session import settled


def argmax(value: Column, index: Column) -> Column:
    """Aggregate: the index of the largest value, the lowest index of equals."""
    return -F.max(F.struct(value.alias("v"), (-index).alias("i")))["i"]


def argmin(value: Column, index: Column) -> Column:
    """Aggregate: the index of the smallest value, the lowest index of equals."""
    return F.min(F.struct(value.alias("v"), index.alias("i")))["i"]


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows of a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def first_of_each(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row for each key, the one of least position (an aggregate, not a sort of the groups)."""
    rest = [c for c in df.columns if c not in (*key, position)]
    first = F.min(F.struct(position, *rest)).alias("first")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"first.{c}").alias(c) for c in (position, *rest)])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all: ranges are numbered by themselves and shifted by the sizes of those before.

    The ranges are checkpointed, so that sizes and numbers are of the same ones.
    """
    own = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = own.groupBy("_part").agg(F.count("*").alias("n"))  # a row a range
    before = sizes.withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return own.join(F.broadcast(before), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_before")


def fold(number: Column, k: int) -> Column:
    """Round-robin fold from 1 of a row number from 1."""
    return (number - 1) % k + 1


def compact(df: DataFrame, by: list[str], old: str, keep: Column, new: str) -> DataFrame:
    """Rows to keep, numbered anew from 1 within each group by a running sum over the old numbers."""
    w = Window.partitionBy(*by).orderBy(old).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_keep", keep.cast("int")).withColumn(new, F.sum("_keep").over(w)).filter("_keep = 1").drop("_keep")


def group_starts(by: Column, order: list[Column], within: list[str]) -> Column:
    """Whether a row's id differs from the one before it in its group."""
    before = F.lag(by).over(Window.partitionBy(*within).orderBy(*order))
    return before.isNull() | (before != by)


def quantiles(df: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """(by, name): the p-quantile of each group, with midpoints at (i - 0.5) / n.

    Equal values are counted before anything is put in order, and only the two rows about the quantile are kept of a group.
    """
    counts = df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("v")
    own = counts.withColumn("to", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    at = F.least(F.greatest(p * F.col("all") + 0.5, F.lit(1.0)), F.col("all").cast("double"))
    own = own.withColumn("at", at).withColumn("lo", F.floor("at")).withColumn("hi", F.least(F.floor("at") + 1, F.col("all")))
    holds = lambda c: (F.col(c) > F.col("to") - F.col("n")) & (F.col(c) <= F.col("to"))
    ends = own.groupBy(*by).agg(F.max(F.when(holds("lo"), F.col("v"))).alias("a"), F.max(F.when(holds("hi"), F.col("v"))).alias("b"), F.first(F.col("at") - F.col("lo")).alias("share"))
    return ends.select(*by, (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias(name))
