"""Grids as rows (photo, y, x, value): runs, resampling, filters, distance transforms, class templates and limbs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.functions.ranking import argmax
from regiolith.functions.scalar import gaussian2, ratio
from regiolith.session import per_group


def runs_dense(runs: DataFrame, by: list[str], size: DataFrame) -> DataFrame:
    """(by, position, value) for positions 1 to n of each group (by, n): runs (by, start, values) written out, zero elsewhere, the later run on top."""
    cells = runs.select(*by, "start", F.posexplode("values").alias("i", "value")).select(*by, (F.col("start") + F.col("i")).alias("position"), "start", "value")
    last = cells.groupBy(*by, "position").agg(F.max_by("value", "start").alias("value"))
    all_ = size.select(*by, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("position"))
    return all_.join(last, [*by, "position"], "left").select(*by, "position", F.coalesce("value", F.lit(0.0)).alias("value"))


def resample(grid: DataFrame, at: DataFrame) -> DataFrame:
    """(photo, yq, xq, value): bilinear interpolation at points (photo, yq, xq); null outside of the grid."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (0, 1) for b in (0, 1)])).alias("c")
    fy, fx = F.floor("yq"), F.floor("xq")
    near = at.select("photo", "yq", "xq", fy.alias("y0"), fx.alias("x0"), corner)
    part = lambda q, low, d: F.when(d == 0, 1 - (q - low)).otherwise(q - low)
    weight = part(F.col("yq"), F.col("y0"), F.col("c.dy")) * part(F.col("xq"), F.col("x0"), F.col("c.dx"))
    near = near.select("photo", "yq", "xq", (F.col("y0") + F.col("c.dy")).alias("y"), (F.col("x0") + F.col("c.dx")).alias("x"), weight.alias("weight")).filter("weight > 0")
    met = near.join(grid.select("photo", "y", "x", "value"), ["photo", "y", "x"], "left")
    sums = met.groupBy("photo", "yq", "xq").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count("value").alias("n"), F.count("*").alias("need"))
    return sums.select("photo", "yq", "xq", F.when(F.col("n") == F.col("need"), F.col("value")).alias("value"))


def envelope(f: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """min over p of a (q - p)^2 + b (q - p) + f(p) for every q, and the p that gives it, by the lower envelope of the parabolas; a > 0."""
    hull, ends = [0], [-math.inf]
    for q in range(1, len(f)):
        while True:
            p = hull[-1]
            cross = (f[q] - f[p] - b * (q - p) + a * (q * q - p * p)) / (2 * a * (q - p))
            if cross > ends[-1]:
                break
            hull.pop()
            ends.pop()
        hull.append(q)
        ends.append(cross)
    at = np.array(hull)[np.searchsorted(ends, np.arange(len(f)), "left").clip(1) - 1] if len(f) else np.zeros(0, int)
    d = np.arange(len(f)) - at
    return a * d * d + b * d + f[at], at


def distance_transform(grid: DataFrame, ay: float, by: float, ax: float, bx: float) -> DataFrame:
    """(photo, y, x, value, from_y, from_x): the cheapest move to each cell from any, along x and then along y; a photo's full grid fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ys, xs = np.unique(pdf["y"]), np.unique(pdf["x"])
        f = np.full((len(ys), len(xs)), np.inf)
        f[np.searchsorted(ys, pdf["y"]), np.searchsorted(xs, pdf["x"])] = pdf["value"]
        f = np.where(np.isfinite(f), f, 1e20)
        along = [envelope(row, ax, bx) for row in f]
        g, px = np.array([v for v, _ in along]), np.array([p for _, p in along])
        down = [envelope(col, ay, by) for col in g.T]
        h, py = np.array([v for v, _ in down]).T, np.array([p for _, p in down]).T
        y, x = (i.ravel() for i in np.indices(h.shape))
        best = px[py.ravel(), x]
        return pd.DataFrame({"photo": pdf["photo"].iloc[0], "y": ys[y], "x": xs[x], "value": h.ravel(), "from_y": ys[py.ravel()], "from_x": xs[best]})

    kinds = dict(grid.dtypes)
    return per_group(grid, ["photo"], run, f"photo {kinds['photo']}, y int, x int, value double, from_y int, from_x int")


def gabor(sigma: float, theta: float, wavelength: float = 16.0, phase: float = math.pi / 2, aspect: float = 1.0) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of a Gabor filter that reaches three deviations along its turned axes."""
    across = sigma / aspect
    reach = lambda c, s: math.ceil(max(1.0, abs(3 * sigma * c), abs(3 * across * s)))
    xs, ys = reach(math.cos(theta), math.sin(theta)), reach(math.sin(theta), math.cos(theta))
    out = []
    for y in range(-ys, ys + 1):
        for x in range(-xs, xs + 1):
            u, v = x * math.cos(theta) + y * math.sin(theta), y * math.cos(theta) - x * math.sin(theta)
            out.append((y, x, math.exp(-0.5 * (u * u / sigma**2 + v * v / across**2)) * math.cos(2 * math.pi / wavelength * u + phase) / (2 * math.pi * sigma * across)))
    return out


def filtered(grid: DataFrame, bank: dict[str, list[tuple[int, int, float]]]) -> DataFrame:
    """(photo, y, x, filter, value): correlation with each filter of a bank, cells outside counting as 0.

    The bank is a constant of a few hundred weights; a cell's neighbours are read by an equi-join.
    """
    spark = grid.sparkSession
    weights = spark.createDataFrame([(name, dy, dx, w) for name, own in bank.items() for dy, dx, w in own], "filter string, dy int, dx int, w double")
    cells = grid.select("photo", "y", "x")
    wide = grid.select("photo", "y", "x", "value").crossJoin(F.broadcast(weights))
    sums = wide.groupBy("photo", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "filter").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return sums.join(cells, ["photo", "y", "x"], "left_semi").select("photo", "y", "x", "filter", "value")


# ---------------------------------------------------------------- limbs and class templates


def limb_scores(pixels: DataFrame, limbs: DataFrame, along: float, across: float) -> DataFrame:
    """(photo, seg, limb, side, value): the sum over a segment's pixels (photo, seg, x, y) of a Gaussian stretched along the limb.

    limbs: photo, limb, side, x1, y1, x2, y2.  A photo's limbs are few; pixels meet
    those of their own photo and are added up before anything is shuffled by segment.
    """
    met = pixels.select("photo", "seg", "x", "y").join(limbs, "photo")
    dx, dy = F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2
    density = gaussian2(dx, dy, F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), along, across)
    return met.groupBy("photo", "seg", "limb", "side").agg(F.sum(density).alias("value"))


def limb_labels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(photo, limb, side, class): by segment scores (photo, seg, limb, side, value) the class (photo, seg, class) of largest sum; side 3 is both together."""
    own = scores.join(labels, ["photo", "seg"])
    both = own.withColumn("side", F.explode(F.array(F.col("side"), F.lit(3).cast("int"))))
    sums = both.groupBy("photo", "limb", "side", "class").agg(F.sum("value").alias("v"))
    return sums.groupBy("photo", "limb", "side").agg(argmax(F.col("v"), F.col("class")).alias("class"))


def best_scales(pixels: DataFrame, inside, scales: list[float]) -> DataFrame:
    """(class, scale, score) of the best scale of each class, the smallest of equals.

    pixels: photo, t.  inside(scale) tells whether the class template at that scale
    covers a pixel.  Hits, false alarms and misses of all scales are sums of one
    pass, by photo and class; a photo's score is hits over all three, and photos are averaged.
    """
    hits = [F.sum(inside(s).cast("int")).alias(f"s{i}") for i, s in enumerate(scales)]
    own = pixels.groupBy("photo", F.col("t").alias("class")).agg(F.count("*").alias("n"), *hits)
    all_ = pixels.groupBy("photo").agg(*hits).select("photo", *[F.col(f"s{i}").alias(f"a{i}") for i in range(len(scales))])
    both = own.join(all_, "photo")
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("scale"), ratio(F.col(f"s{i}"), F.col("n") + F.col(f"a{i}") - F.col(f"s{i}")).alias("score")) for i, s in enumerate(scales)]))
    mean = both.select("class", each).groupBy("class", "scale").agg(F.avg("score").alias("score"))
    top = F.max(F.struct(F.round("score", 9).alias("v"), (-F.col("scale")).alias("i")))
    return mean.groupBy("class").agg(top.alias("m")).select("class", (-F.col("m.i")).alias("scale"), F.col("m.v").alias("score"))


def mean_masks(pixels: DataFrame, y: Column, x: Column, cells: int) -> DataFrame:
    """(class, cy, cx, value): how much of a cell of a cells x cells grid a class covers, averaged over the photos that have the class.

    pixels: photo, t; y and x from 0 to 1.
    """
    cell = lambda v: F.least(F.lit(cells - 1), F.floor(v * cells)).cast("int")
    own = pixels.select("photo", F.col("t").alias("class"), cell(y).alias("cy"), cell(x).alias("cx"))
    n = own.groupBy("photo", "cy", "cx", "class").agg(F.count("*").alias("n"))
    whole = n.groupBy("photo", "cy", "cx").agg(F.sum("n").alias("whole"))
    share = n.join(whole, ["photo", "cy", "cx"]).groupBy("class", "cy", "cx").agg(F.sum(F.col("n") / F.col("whole")).alias("v"))
    photos = own.select("photo", "class").distinct().groupBy("class").agg(F.count("*").alias("photos"))
    return share.join(photos, "class").select("class", "cy", "cx", (F.col("v") / F.col("photos")).alias("value"))


def mean_of_positive(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): the mean over the parts that have a positive value, 0 where none has."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    return parts.groupBy(*by).agg(F.coalesce(F.avg(positive), F.lit(0.0)).alias("value"))


def fused(cues: list[Column], weights: list[float]) -> Column:
    """A weighted sum of boundary cues."""
    return sum((w * c for w, c in zip(weights[1:], cues[1:])), weights[0] * cues[0])


def covers(window: list[Column], box: list[Column], least: float) -> Column:
    """Whether a window (x1, y1, x2, y2) overlaps a box by more than a share, ends inclusive."""
    side = lambda a, b, i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]) + 1)
    area = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    both = side(window, box, 0) * side(window, box, 1)
    return F.coalesce(ratio(both, area(window) + area(box) - both) > least, F.lit(False))


def windows_of(x: Column, y: Column, size: Column | float, scale: Column | float, pad: Column | float) -> list[Column]:
    """The box in the image of the filter response at (x, y), from 1, of a pyramid level."""
    x1, y1 = (x - pad - 1) * scale + 1, (y - pad - 1) * scale + 1
    return [x1, y1, x1 + size * scale - 1, y1 + size * scale - 1]
