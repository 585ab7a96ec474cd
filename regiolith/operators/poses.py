"""Poses as joints (photo, joint, x, y): mirroring, limbs, boxes and lines between points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.functions.scalar import flip_x

# The joints that have a left and a right one.
PAIRED = ("shoulder", "elbow", "hand", "hip", "knee", "ankle")


def mirrored(joints: DataFrame, width: Column) -> DataFrame:
    """Joints as seen in a mirror: x turned about the photo's width, left and right joints exchanged."""
    side, rest = F.split("joint", "_")[0], F.split("joint", "_")[1]
    other = F.when(side == "left", F.lit("right_")).otherwise(F.lit("left_"))
    swapped = F.when(side.isin("left", "right") & rest.isin(*PAIRED), F.concat(other, rest)).otherwise(F.col("joint"))
    return joints.withColumn("x", flip_x(F.col("x"), width)).withColumn("joint", swapped)


def augmented(joints: DataFrame, width: Column, shift: int) -> DataFrame:
    """The photos and their mirror images, whose numbers are shift higher."""
    other = mirrored(joints, width).withColumn("photo", F.col("photo") + shift)
    return joints.unionByName(other)


def limb_polygon(x1: Column, y1: Column, x2: Column, y2: Column, half_width: Column) -> list[Column]:
    """The corners (x, y) of the rectangle about a line, in turn; a line without length lies along x."""
    dx, dy = x1 - x2, y1 - y2
    length = F.sqrt(dx * dx + dy * dy)
    mx = -half_width * F.coalesce(F.try_divide(dy, length), F.lit(0.0))
    my = half_width * F.coalesce(F.try_divide(dx, length), F.lit(1.0))
    return [F.struct((x + s * mx).alias("x"), (y + s * my).alias("y")) for x, y, s in ((x1, y1, 1), (x1, y1, -1), (x2, y2, -1), (x2, y2, 1))]


def box_centres(row: Column) -> Column:
    """The centres (x, y) of the boxes x1, y1, x2, y2, ... that a detection lists before its component and score."""
    n = ((F.size(row) - 2) / 4).cast("int")
    mean = lambda i, k: (F.element_at(row, 4 * i + k) + F.element_at(row, 4 * i + k + 2)) / 2
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(mean(i, 1).alias("x"), mean(i, 2).alias("y")))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """On which side of the line from a to b the point c lies: 1, 0 or -1."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def crossing(p: list[Column], q: list[Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point, ends included."""
    a, b = turn(*p, q[0], q[1]), turn(*p, q[2], q[3])
    c, d = turn(*q, p[0], p[1]), turn(*q, p[2], p[3])
    apart = lambda i: (F.greatest(p[i], p[i + 2]) < F.least(q[i], q[i + 2])) | (F.greatest(q[i], q[i + 2]) < F.least(p[i], p[i + 2]))
    return (a * b <= 0) & (c * d <= 0) & ~apart(0) & ~apart(1)


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """(photo, s1, s2), s1 < s2, of a photo's segments (photo, seg, x1, y1, x2, y2) that cross; they meet by the strips of x that they reach."""
    def dealt(i: int) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{i}") for c in ("x1", "y1", "x2", "y2")]
        strip = F.explode(F.sequence(F.floor(F.least("x1", "x2") / cell), F.floor(F.greatest("x1", "x2") / cell))).alias("strip")
        return segments.select("photo", F.col("seg").alias(f"s{i}"), *cols, strip)

    ends = [[F.col(f"{c}_{i}") for c in ("x1", "y1", "x2", "y2")] for i in (1, 2)]
    first = F.floor(F.greatest(F.least("x1_1", "x2_1"), F.least("x1_2", "x2_2")) / cell)
    return dealt(1).join(dealt(2), ["photo", "strip"]).filter((F.col("s1") < F.col("s2")) & (F.col("strip") == first)).filter(crossing(*ends)).select("photo", "s1", "s2")
