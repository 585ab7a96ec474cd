"""Confusion matrices and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions.scalar import ratio


def confusion(rows: DataFrame, classes: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, t, p, n) for every pair of classes (class), 0 where there is none; rows of other labels don't count.

    The grid of classes is the only product, and has as many rows as the matrix.
    """
    by = by or []
    known = classes.select(F.col("class"))
    own = rows.join(known.withColumnRenamed("class", "t"), "t", "left_semi").join(known.withColumnRenamed("class", "p"), "p", "left_semi")
    n = own.groupBy(*by, "t", "p").agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    grid = classes.select(F.col("class").alias("t")).crossJoin(classes.select(F.col("class").alias("p")))
    if by:
        grid = n.select(*by).distinct().crossJoin(grid)
    return grid.join(n, [*by, "t", "p"], "left").select(*by, "t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def by_class(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class, tp, n_true, n_pred, precision, recall, f1, iou) of a full matrix; undefined ones are null."""
    by = by or []
    n, tp = F.col("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(*by, F.col("t").alias("class")).agg(F.sum(n).alias("n_true"), tp.alias("tp"))
    cols = matrix.groupBy(*by, F.col("p").alias("class")).agg(F.sum(n).alias("n_pred"))
    t, p, x = F.col("n_true"), F.col("n_pred"), F.col("tp")
    return rows.join(cols, [*by, "class"]).select(*by, "class", "tp", "n_true", "n_pred", ratio(x, p).alias("precision"), ratio(x, t).alias("recall"), ratio(2 * x, t + p).alias("f1"), ratio(x, t + p - x).alias("iou"))


def summary(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, accuracy, and means over the classes for which a measure is defined)."""
    return by_class(matrix, by).groupBy(*(by or [])).agg(
        ratio(F.sum("tp"), F.sum("n_true")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg("iou").alias("iou")
    )


def weighted(rows: DataFrame, sample_weight: Column, class_weights: DataFrame | None = None) -> DataFrame:
    """Per-class measures with weights of samples and of true classes (class, w); classes are those seen on either side."""
    classes = rows.select(F.col("t").alias("class")).union(rows.select("p")).distinct()
    own = rows.withColumn("_w", sample_weight.cast("double"))
    if class_weights is not None:
        own = own.join(class_weights.select(F.col("class").alias("t"), F.col("w").alias("_cw")), "t", "left").withColumn("_w", F.col("_w") * F.coalesce("_cw", F.lit(1.0)))
    return by_class(confusion(own, classes, weight=F.col("_w")))


def sweep(rows: DataFrame, score: Column, positive: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, n_selected, precision, recall, iou) of score > threshold; one pass, thresholds from a constant array."""
    rows = rows.select(score.alias("score"), positive.cast("int").alias("positive")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = (F.col("score") > F.col("threshold")).cast("int")
    sums = rows.groupBy("threshold").agg(F.sum(hit).alias("n_selected"), F.sum(hit * F.col("positive")).alias("tp"), F.sum("positive").alias("n_positive"))
    return sums.select("threshold", "n_selected", ratio(F.col("tp"), F.col("n_selected")).alias("precision"), ratio(F.col("tp"), F.col("n_positive")).alias("recall"), ratio(F.col("tp"), F.col("n_selected") + F.col("n_positive") - F.col("tp")).alias("iou"))


def running_accuracy(rows: DataFrame, by: list[str], order: str, right: Column) -> DataFrame:
    """Accuracy up to and including each row of its group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("accuracy", F.avg(right.cast("int")).over(w))


def joint_errors(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The distance of each joint (key, x, y) from where it is."""
    t, f = truth.select(*key, F.col("x").alias("tx"), F.col("y").alias("ty")), found.select(*key, "x", "y")
    return t.join(f, key).withColumn("error", F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2))


def sticks_right(truth: list[Column], found: list[Column], least: float = 0.5) -> Column:
    """Whether both ends of a stick (x1, y1, x2, y2) lie near the true ones: mean offsets along and across under a share of its length.

    A stick whose first end is nearer to the true second one is turned round first.
    """
    x1, y1, x2, y2 = truth
    turned = (found[0] - x2) ** 2 + (found[1] - y2) ** 2 < (found[0] - x1) ** 2 + (found[1] - y1) ** 2
    found = [F.when(turned, b).otherwise(a) for a, b in zip(found, [*found[2:], *found[:2]])]
    length = F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
    ux, uy = F.try_divide(x2 - x1, length), F.try_divide(y2 - y1, length)
    ends = [(found[0] - x1, found[1] - y1), (found[2] - x2, found[3] - y2)]
    along = sum((F.abs(ux * dx + uy * dy) for dx, dy in ends), F.lit(0.0)) / 2 / length
    across = sum((F.abs(ux * dy - uy * dx) for dx, dy in ends), F.lit(0.0)) / 2 / length
    return F.coalesce((along < least) & (across < least), F.lit(False))


def detection_rates(sticks: DataFrame) -> DataFrame:
    """(part, detection_rate, pcp, part_rate) of sticks (photo, part, right), right null throughout a photo where no person was found.

    The detection rate is over all photos, the share of correct parts over the photos with a detection.
    """
    photos = sticks.groupBy("photo").agg(F.max(F.col("right").isNotNull().cast("int")).alias("found"))
    rates = photos.agg(F.avg("found").alias("detection_rate"))
    own = sticks.join(photos.filter("found = 1").select("photo"), "photo", "left_semi").withColumn("hit", F.coalesce(F.col("right").cast("double"), F.lit(0.0)))
    whole = own.agg(F.avg("hit").alias("pcp"))
    return own.groupBy("part").agg(F.avg("hit").alias("part_rate")).crossJoin(rates).crossJoin(whole).select("part", "detection_rate", "pcp", "part_rate")


def report(classes: DataFrame, frequency: DataFrame) -> DataFrame:
    """(rank, class, precision, recall, iou, frequency), the most frequent class first, ties by class.  The classes are few."""
    rank = F.row_number().over(Window.orderBy(F.desc("frequency"), "class"))
    return classes.join(frequency, "class").select(rank.alias("rank"), "class", "precision", "recall", "iou", "frequency")
