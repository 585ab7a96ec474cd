"""Aggregates of pixels by region, votes, and the expansion of scores through class maps.

Pixels are rows (photo, seg, ...); a region is the rows that share photo and seg.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions.ranking import argmax
from regiolith.functions.scalar import histogram_bin, ratio

REGION = ["photo", "seg"]
Aggregator = Callable[[str], Column]
DEFAULT: dict[str, Aggregator] = {"mean": F.avg, "std": F.stddev_samp}


def areas(pixels: DataFrame, weight: Column | None = None) -> DataFrame:
    return pixels.groupBy(*REGION).agg((F.count("*") if weight is None else F.sum(weight)).alias("area"))


def features(pixels: DataFrame, channels: Mapping[str, Mapping[str, Aggregator]] | list[str]) -> DataFrame:
    """One row a region; channels: names, or by name the aggregates to take of it (mean and sample deviation else)."""
    each = channels if isinstance(channels, Mapping) else dict.fromkeys(channels, DEFAULT)
    return pixels.groupBy(*REGION).agg(*[f(c).alias(f"{c}_{name}") for c, own in each.items() for name, f in own.items()])


def boxes(pixels: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    return pixels.groupBy(*REGION).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def histogram(rows: DataFrame, by: list[str], channels: dict[str, tuple[float, float]], n: int = 11) -> DataFrame:
    """(by, channel, bin, share): counts at the nearest of n centres, over the total of all channels.  One pass for all channels."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), histogram_bin(F.col(c), low, high, n).alias("bin")) for c, (low, high) in channels.items()])
    counts = rows.select(*by, F.inline(each)).groupBy(*by, "channel", "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")


def inside(pixels: DataFrame, roi: Column, least: float = 0.75) -> DataFrame:
    """Regions of which more than this share lies in the region of interest."""
    return pixels.groupBy(*REGION).agg((F.sum(roi.cast("int")) / F.count("*")).alias("share")).filter(F.col("share") > least)


def vote(pixels: DataFrame, by: list[str], label: str, weight: str) -> DataFrame:
    """The label of largest weight sum in each group, the lowest of equals."""
    sums = pixels.groupBy(*by, label).agg(F.sum(weight).alias("votes"))
    return sums.groupBy(*by).agg(argmax(F.col("votes"), F.col(label)).alias(label), F.max("votes").alias("votes"))


def judged(pixels: DataFrame, by: list[str], label: str, weight: str) -> DataFrame:
    """(by, t, p, n): for each label of a region the pixels that have it, and the region's vote.

    The pixels are aggregated once, by region and label; the vote is taken among the labels of a region.
    """
    sums = pixels.groupBy(*by, F.col(label).alias("t")).agg(F.sum(weight).alias("v"), F.count("*").alias("n"))
    whole = sums.groupBy(*by).agg(argmax(F.col("v"), F.col("t")).alias("p"), F.collect_list(F.struct("t", "n")).alias("own"))  # an entry a class
    return whole.select(*by, "p", F.inline("own"))


def spread_labels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixels with the label of their region."""
    return pixels.join(labels, REGION)


def mean_scores(pixels: DataFrame, heat: DataFrame) -> DataFrame:
    """(photo, seg, class, score): the mean over a region's pixels of a heat map (photo, y, x, class, value)."""
    area = areas(pixels)
    total = pixels.join(heat, ["photo", "y", "x"]).groupBy(*REGION, "class").agg(F.sum("value").alias("total"))
    return total.join(area, REGION).select(*REGION, "class", (F.col("total") / F.col("area")).alias("score"))


def inside_outside(pixels: DataFrame, mask: Column, weight: Column) -> DataFrame:
    """(photo, seg, inside, outside): weighted shares of a region in and out of a mask."""
    return pixels.groupBy(*REGION).agg((F.sum(mask.cast("int") * weight) / F.count("*")).alias("inside"), (F.sum((~mask).cast("int") * weight) / F.count("*")).alias("outside"))


def class_frequency(pixels: DataFrame, train: DataFrame) -> DataFrame:
    """(t, frequency, presence): mean pixels a training photo, and in how many of them a class occurs.  train: photo."""
    n = train.select("photo").distinct().agg(F.count("*").alias("n_photos"))
    own = pixels.join(train.select("photo").distinct(), "photo", "left_semi").groupBy("t", "photo").agg(F.count("*").alias("n"))
    return own.groupBy("t").agg(F.sum("n").alias("total"), F.count("*").alias("presence")).join(F.broadcast(n)).select("t", ratio(F.col("total"), F.col("n_photos")).alias("frequency"), "presence")


def through_bridge(scores: DataFrame, bridge: DataFrame) -> DataFrame:
    """Scores (..., fine, value) summed into classes by a map (fine, target); targets without any entry don't appear."""
    by = [c for c in scores.columns if c not in ("fine", "value")]
    return scores.join(bridge, "fine").groupBy(*by, "target").agg(F.sum("value").alias("value"))


def cell_histogram(rows: DataFrame, by: list[str], cell_y: Column, cell_x: Column, word: str) -> DataFrame:
    """Word counts by grid cell, each with the total of the 2 x 2 block that starts at it."""
    cells = rows.groupBy(*by, cell_y.alias("cy"), cell_x.alias("cx"), word).agg(F.count("*").alias("n"))
    totals = cells.groupBy(*by, "cy", "cx").agg(F.sum("n").alias("total"))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)]))
    block = totals.select(*by, "cy", "cx", "total", shift.alias("s")).groupBy(*by, (F.col("cy") - F.col("s.dy")).alias("cy"), (F.col("cx") - F.col("s.dx")).alias("cx")).agg(F.sum("total").alias("block"))
    return cells.join(block, [*by, "cy", "cx"])
