"""Pairs of regions: all of a photo, neighbours, their features, and counts of label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions.geometry import fill_similarity, size_similarity
from regiolith.functions.scalar import intersection, pair_vector, ratio


def unordered(segments: DataFrame, keep: Column | None = None) -> DataFrame:
    """(photo, s1, s2), s1 < s2, of each photo's regions; an equi-join on photo with the order as condition.

    The regions of a photo are few; their pairs are the operator's result.
    """
    own = (segments if keep is None else segments.filter(keep)).select("photo", "seg")
    a, b = own.withColumnRenamed("seg", "s1"), own.withColumnRenamed("seg", "s2")
    return a.join(b, "photo").filter("s1 < s2")


def met(segments: DataFrame, cols: list[str]) -> DataFrame:
    """unordered() with columns of both ends, as c_1 and c_2, by one join on photo."""
    end = lambda i: segments.select("photo", F.col("seg").alias(f"s{i}"), *[F.col(c).alias(f"{c}_{i}") for c in cols])
    return end(1).join(end(2).hint("merge"), "photo").filter("s1 < s2")


def neighbours(segments: DataFrame, cols: list[str]) -> DataFrame:
    """(photo, s1, s2) of a photo's regions of successive numbers, s2 = s1 + 1, with columns of both ends, as c_1 and c_2.  A number is one region's."""
    within = Window.partitionBy("photo").orderBy("seg")
    both = segments.select("photo", F.col("seg").alias("s1"), F.lead("seg").over(within).alias("s2"), *[F.col(c).alias(f"{c}_1") for c in cols], *[F.lead(c).over(within).alias(f"{c}_2") for c in cols])
    return both.filter("s2 = s1 + 1")


def adjacent(pixels: DataFrame) -> DataFrame:
    """(photo, s1, s2), s1 <= s2, distinct, of horizontal and vertical neighbours in a grid (photo, y, x, seg)."""
    rows = Window.partitionBy("photo", "y").orderBy("x")
    cols = Window.partitionBy("photo", "x").orderBy("y")
    near = lambda w, c: F.when(F.lead(c).over(w) == F.col(c) + 1, F.lead("seg").over(w))
    both = pixels.select("photo", "seg", near(rows, "x").alias("right"), near(cols, "y").alias("below"))
    both = both.select("photo", "seg", F.explode(F.array("right", "below")).alias("other")).filter("other IS NOT NULL")
    return both.select("photo", F.least("seg", "other").alias("s1"), F.greatest("seg", "other").alias("s2")).distinct()


def successive(rows: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """(by, a, b): the labels of rows that follow each other."""
    following = F.lead(label).over(Window.partitionBy(*by).orderBy(*order))
    return rows.select(*by, F.col(label).alias("a"), following.alias("b")).filter("b IS NOT NULL")


def gather(pairs: DataFrame, segments: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs with columns of both ends, as c_1 and c_2."""
    end = lambda i: segments.select("photo", F.col("seg").alias(f"s{i}"), *[F.col(c).alias(f"{c}_{i}") for c in cols])
    return pairs.join(end(1), ["photo", "s1"]).join(end(2), ["photo", "s2"])


def features(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(photo, s1, s2, features) from regions' features array<double>."""
    return gather(pairs, segments, ["features"]).select("photo", "s1", "s2", pair_vector(F.col("features_1"), F.col("features_2")).alias("features"))


def reindexed(pairs: DataFrame, segments: DataFrame, keep: Column) -> DataFrame:
    """The pairs of which both ends are kept, with the numbers, from 1, that the kept segments get in their photo."""
    new = segments.filter(keep).select("photo", "seg", F.row_number().over(Window.partitionBy("photo").orderBy("seg")).alias("new"))
    ends = [new.select("photo", F.col("seg").alias(f"s{i}"), F.col("new").alias(f"n{i}")) for i in (1, 2)]
    return pairs.join(ends[0], ["photo", "s1"]).join(ends[1], ["photo", "s2"]).select("photo", F.col("n1").alias("s1"), F.col("n2").alias("s2"))


def merge_similarity(a: dict[str, Column], b: dict[str, Column], hull: Column, whole: Column) -> Column:
    """How well two regions go together: the sum of likeness in colour, texture, size and fill, each from 0 to 1.

    a, b: colour and texture (histograms that sum to 1) and size; hull: the size of the box about both; whole: that of the image.
    """
    like = intersection(a["colour"], b["colour"]) + intersection(a["texture"], b["texture"])
    return like + size_similarity(a["size"], b["size"], whole) + fill_similarity(hull, a["size"], b["size"], whole)


def prior(label_pairs: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, p): the share of each unordered label pair among a group's pairs, averaged over the groups that have it, the larger of both directions."""
    n = label_pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    one = share.groupBy("a", "b").agg(F.avg("share").alias("p"))
    return one.union(one.select("b", "a", "p")).groupBy("a", "b").agg(F.max("p").alias("p"))


def fill_prior(p: DataFrame, classes: DataFrame) -> DataFrame:
    """The prior on the whole grid of classes (class); pairs never seen get half the least."""
    least = p.agg((F.min("p") / 2).alias("least"))
    grid = classes.select(F.col("class").alias("a")).crossJoin(classes.select(F.col("class").alias("b")))
    return grid.join(p, ["a", "b"], "left").join(F.broadcast(least)).select("a", "b", F.coalesce("p", "least").alias("p"))


def cooccurrence(label_pairs: DataFrame) -> DataFrame:
    """(a, b, n, share): counts of ordered label pairs, and each over its column's total."""
    n = label_pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.coalesce(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("b"))), F.lit(0.0)))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], overlap: Column, cell: float) -> DataFrame:
    """Box pairs (a of left, b of right) of a group that touch, with their overlap.

    Boxes are dealt to square cells of the given side and meet where they share
    one; of several, the cell of the larger of the two upper left corners counts.
    """
    def dealt(df: DataFrame, name: str) -> DataFrame:
        span = lambda p, q: F.sequence(F.floor(F.col(f"{name}.{p}") / cell), F.floor(F.col(f"{name}.{q}") / cell))
        return df.withColumn("cr", F.explode(span("r0", "r1"))).withColumn("cc", F.explode(span("c0", "c1")))

    met = dealt(left, "a").join(dealt(right, "b"), [*by, "cr", "cc"])
    first = (F.col("cr") == F.floor(F.greatest("a.r0", "b.r0") / cell)) & (F.col("cc") == F.floor(F.greatest("a.c0", "b.c0") / cell))
    return met.filter(first).withColumn("overlap", overlap).drop("cr", "cc")
