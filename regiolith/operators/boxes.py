"""Boxes by group: suppression of overlapping ones, and how well candidates cover the truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.functions import geometry as geo
from regiolith.functions.ranking import top_k
from regiolith.session import reach_workers


def greedy(b: np.ndarray, score: np.ndarray, most: float = 0.5) -> np.ndarray:
    """Rows kept: best first, each drops those of which it covers more than a share; b: (n, parts, 4), ends inclusive."""
    area = ((b[:, :, 2] - b[:, :, 0] + 1) * (b[:, :, 3] - b[:, :, 1] + 1)).sum(axis=1)
    left, kept = np.argsort(-score, kind="stable"), []
    while len(left):
        i, left = left[0], left[1:]
        kept.append(i)
        h = np.minimum(b[i, :, 2], b[left, :, 2]) - np.maximum(b[i, :, 0], b[left, :, 0]) + 1
        w = np.minimum(b[i, :, 3], b[left, :, 3]) - np.maximum(b[i, :, 1], b[left, :, 1]) + 1
        left = left[(np.maximum(h, 0) * np.maximum(w, 0)).sum(axis=1) <= most * area[left]]
    return np.array(kept, int)


def suppress(boxes: DataFrame, by: list[str], most: float = 0.5, top: int = 1000) -> DataFrame:
    """(by, seg, score) of the boxes left; only the top boxes of a group take part, so a group fits its task."""
    best = top_k(boxes, by, [F.desc("score"), F.col("seg")], top).select(*by, "seg", "score", "box.*")
    kinds = dict(best.dtypes)
    ends = [F.col(c).cast("double").alias(c) for c in ("r0", "c0", "r1", "c1")]
    packed = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "seg", "score", *ends))).alias("own"))  # at most `top` boxes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                b = np.array([[x["r0"], x["c0"], x["r1"], x["c1"]] for x in row.own], float)
                kept = greedy(b[:, None, :], -np.arange(len(b)), most)  # they come best first
                out += [(*(getattr(row, c) for c in by), row.own[i]["seg"], row.own[i]["score"]) for i in kept.tolist()]
            yield pd.DataFrame(out, columns=[*by, "seg", "score"])

    reach_workers(boxes.sparkSession)
    return packed.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "seg", "score")))


def best_overlaps(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, seg, class, best, best_seg): for each true box the best overlap with a candidate of its group, 0 without any."""
    c = found.select(*by, F.col("seg").alias("other"), F.col("box").alias("b"))
    o = geo.overlap(F.col("box"), F.col("b"))
    met = truth.join(c, by, "left").withColumn("o", F.coalesce(o, F.lit(0.0)))
    best = F.max(F.struct(F.col("o"), (-F.col("other")).alias("i")))
    return met.groupBy(*by, "seg", "class").agg(best.alias("m")).select(*by, "seg", "class", F.col("m.o").alias("best"), (-F.col("m.i")).alias("best_seg"))


def average_best(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(class, n, abo): the mean of the best overlaps of each class."""
    return best_overlaps(truth, found, by).groupBy("class").agg(F.count("*").alias("n"), F.avg("best").alias("abo"))
