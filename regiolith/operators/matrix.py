"""Matrices, one a group of rows (by, i, j, value): elimination, determinants, ranks and what else NumPy has; and seeded columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions.ranking import numbered
from regiolith.session import per_group


def eliminated(a: np.ndarray, reduced: bool = True, least: float = 1e-12) -> np.ndarray:
    """The row echelon form by pivots of largest size; reduced: with leading ones and zeros above them."""
    a, r = np.array(a, float), 0
    for c in range(a.shape[1]):
        if r == len(a):
            break
        p = r + int(np.argmax(np.abs(a[r:, c])))
        if abs(a[p, c]) <= least:
            a[r:, c] = 0
            continue
        a[[r, p]] = a[[p, r]]
        if reduced:
            a[r] /= a[r, c]
        below = [i for i in range(len(a)) if i != r] if reduced else range(r + 1, len(a))
        for i in below:
            a[i] -= a[r] * (a[i, c] / a[r, c])
            a[i, c] = 0.0
        r += 1
    return a


def determinant(a: np.ndarray) -> float:
    return float(np.linalg.det(a))


def rank(a: np.ndarray) -> int:
    return int((np.abs(eliminated(a, reduced=False)) > 1e-12).any(axis=1).sum())


def per_matrix(cells: DataFrame, by: list[str], function, name: str = "value") -> DataFrame:
    """(by, value): function(matrix) -> number for each group's matrix (i, j from 0, cells left out are 0), which fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1))
        a[pdf["i"], pdf["j"]] = pdf["value"]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), float(function(a))]], columns=[*by, name])

    kinds = dict(cells.dtypes)
    return per_group(cells, by, run, ", ".join(f"{c} {kinds[c]}" for c in by) + f", {name} double")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(*[F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in cells.columns])


def found(cells: DataFrame, where: Column) -> DataFrame:
    """The cells that meet a condition, with their linear place, columns first."""
    height = F.max("i").over(_all(cells)) + 1
    return cells.withColumn("place", F.col("j") * height + F.col("i")).filter(where)


def _all(cells: DataFrame):
    return Window.partitionBy(*[c for c in cells.columns if c not in ("i", "j", "value")])


def product(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, value) of the products of matrices with equal keys: a join on the shared index and a sum."""
    right = b.select(*by, F.col("i").alias("k"), "j", F.col("value").alias("w"))
    left = a.select(*by, "i", F.col("j").alias("k"), "value")
    return left.join(right, [*by, "k"]).groupBy(*by, "i", "j").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


# ---------------------------------------------------------------- seeded numbers


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone, so the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / float(1 << 53)


def normal(key: Column, seed: int) -> Column:
    """A standard normal number by the Box-Muller formula from two uniform ones."""
    u, v = 1 - uniform(key, 2 * seed + 1), uniform(key, 2 * seed + 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)


def shuffled(key: Column, seed: int) -> Column:
    """An order for a random permutation; ties, which are as rare as equal 64-bit hashes, by the key."""
    return F.struct(F.xxhash64(F.lit(seed), key).alias("h"), key.alias("key"))


def weighted_order(weight: Column, u: Column) -> Column:
    """A random order in which rows of small weight tend to come first: the weight times a uniform number."""
    return weight * u


def threshold(values: DataFrame, column: str, share: float) -> float:
    """The value at the ceiling of share * n in rising order, from 1; null for no rows.

    Rows are numbered in ranges, so no task sees all of them.
    """
    own = numbered(values.select(F.col(column).alias("v")), ["v"], "r")
    n = own.count()
    if not n:
        return None
    at = max(1, int(np.ceil(n * share - 1e-9)))
    return float(own.filter(F.col("r") == at).first()["v"])
