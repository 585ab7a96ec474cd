"""The driver's tables seen as regions, pairs, boxes and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.functions.geometry import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo: a supplier; seg: one of its regions; t: the class of the return flag; w: quantity; x, d, tax: channels."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("photo"), (F.col("l_linenumber") * 5 + F.col("l_partkey") % 5).alias("seg"), flag.alias("t"), F.col("l_quantity").alias("w"),
        F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"), F.col("l_orderkey").alias("ord"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo: an order; seg: its lines numbered from 1; t as in pixels()."""
    # by the new name, so that grouping and joining by photo needs no other shuffle
    order = Window.partitionBy("photo").orderBy("n", "part", "supp", "x", "q", "l_shipdate")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("photo"), flag.alias("t"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("d"),
        F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_shipdate",
    )
    return own.select("photo", F.row_number().over(order).alias("seg"), "t", "q", "x", "d", "tax", "n", "part", "supp")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, seg, class, score, box: a box for each order line, from whole numbers."""
    b = box(F.col("q"), F.col("n") * 10.0, F.col("q") + F.round(F.col("d") * 100) + 3, F.col("n") * 10.0 + F.round(F.col("tax") * 100) + 5)
    return lines(spark, sf_dir).select("photo", "seg", F.col("t").alias("class"), F.col("x").alias("score"), b.alias("box"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): each event type's two most frequent followers, w their rank, ties by name."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst IS NOT NULL").groupBy("src", "dst").count()
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))
    return n.select("src", "dst", rank.alias("w")).filter("w <= 2")


def bought_together(spark: SparkSession, sf_dir: str, top: int = 1) -> DataFrame:
    """(src, dst, w): each supplier's most frequent partners in an order, src < dst, w the reciprocal rank order."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = own.withColumnRenamed("l_suppkey", "a"), own.withColumnRenamed("l_suppkey", "b")
    n = a.join(b, "l_orderkey").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return n.withColumn("r", rank).filter(F.col("r") <= top).groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min((1000 - F.col("n")).cast("double")).alias("w"))
