"""Boxes as structs (r0, c0, r1, c1): sizes, overlaps, hulls.  Inclusive ends count the last cell, exclusive ends don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))


def around(row: Column, col: Column, height: Column, width: Column) -> Column:
    """A box from its centre and size."""
    return box(row - height / 2, col - width / 2, row + height / 2, col + width / 2)


def grown(b: Column, factor: float) -> Column:
    """The box scaled about its centre."""
    r, c = (b["r0"] + b["r1"]) / 2, (b["c0"] + b["c1"]) / 2
    return around(r, c, (b["r1"] - b["r0"]) * factor, (b["c1"] - b["c0"]) * factor)


def clipped(b: Column, rows: Column, cols: Column) -> Column:
    low = lambda x: F.greatest(F.lit(1.0), x)
    return box(low(b["r0"]), low(b["c0"]), F.least(rows, b["r1"]), F.least(cols, b["c1"]))


def padded(b: Column, share_rows: float, share_cols: float, least_rows: float, least_cols: float) -> Column:
    """The box with a margin: a share of its sides, at least so much."""
    pad_r = F.greatest(F.lit(least_rows), F.floor((b["r1"] - b["r0"]) * share_rows).cast("double"))
    pad_c = F.greatest(F.lit(least_cols), F.floor((b["c1"] - b["c0"]) * share_cols).cast("double"))
    return box(F.round(b["r0"] - pad_r), F.round(b["c0"] - pad_c), F.round(b["r1"] + pad_r), F.round(b["c1"] + pad_c))


def sides(b: Column, inclusive: bool = True) -> tuple[Column, Column]:
    more = 1 if inclusive else 0
    return b["r1"] - b["r0"] + more, b["c1"] - b["c0"] + more


def area(b: Column, inclusive: bool = True) -> Column:
    h, w = sides(b, inclusive)
    return h * w


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["r0"], b["r0"]), F.least(a["c0"], b["c0"]), F.greatest(a["r1"], b["r1"]), F.greatest(a["c1"], b["c1"]))


def common(a: Column, b: Column) -> Column:
    """The shared box, null where there is none."""
    both = box(F.greatest(a["r0"], b["r0"]), F.greatest(a["c0"], b["c0"]), F.least(a["r1"], b["r1"]), F.least(a["c1"], b["c1"]))
    return F.when((both["r0"] <= both["r1"]) & (both["c0"] <= both["c1"]), both)


def common_area(a: Column, b: Column, inclusive: bool = True) -> Column:
    more = 1 if inclusive else 0
    h = F.least(a["r1"], b["r1"]) - F.greatest(a["r0"], b["r0"]) + more
    w = F.least(a["c1"], b["c1"]) - F.greatest(a["c0"], b["c0"]) + more
    return F.when((h > 0) & (w > 0), h * w).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column, inclusive: bool = True) -> Column:
    """Intersection over union, 0 for disjoint boxes."""
    both = common_area(a, b, inclusive)
    return F.coalesce(F.try_divide(both, area(a, inclusive) + area(b, inclusive) - both), F.lit(0.0))


def wide_enough(b: Column, least: float) -> Column:
    h, w = sides(b)
    return (h >= least) & (w >= least)


def size_similarity(a: Column, b: Column, whole: Column) -> Column:
    """1 less the share of the image that two areas take."""
    return 1 - (a + b) / whole


def fill_similarity(hull_area: Column, a: Column, b: Column, whole: Column) -> Column:
    """1 less the share of the image that their hull adds."""
    return 1 - (hull_area - a - b) / whole
