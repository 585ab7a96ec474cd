"""Clusterers besides k-means under squared distances: medians, coverings, recursive, sampled and by a graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions.scalar import squared_distance
from regiolith.operators import graph
from regiolith.operators.learning import assign, k_means, metric
from regiolith.session import settled


def k_medians(rows: DataFrame, k: int, start: list[list[float]], rounds: int = 20, weight: str | None = None) -> list[list[float]]:
    """Centres under L1 distance: in turn rows (features) go to the nearest, and each centre takes the weighted median of every coordinate.

    start: k centres.  Medians are exact: the weights of equal values are added up
    first, and then along the values in order; a cluster without rows keeps its centre.
    """
    own = settled(rows.select("features", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")))
    centres = [list(map(float, c)) for c in start]
    for _ in range(rounds):
        cells = assign(own, centres, "l1").select("word", "w", F.posexplode("features").alias("i", "v"))
        sums = cells.groupBy("word", "i", "v").agg(F.sum("w").alias("w"))
        within = Window.partitionBy("word", "i")
        so_far = F.sum("w").over(within.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        reached = sums.withColumn("to", so_far).withColumn("all", F.sum("w").over(within)).filter("2 * to >= all")
        low = reached.groupBy("word", "i").agg(F.min(F.col("v").cast("double")).alias("v"))
        new = [list(c) for c in centres]
        for r in low.collect():  # k centres of a few coordinates
            new[r["word"] - 1][r["i"]] = float(r["v"])
        if new == centres:
            return centres
        centres = new
    return centres


def covering(rows: DataFrame, radius: float, most: int, order, distance: str = "l2") -> list[list[float]]:
    """Centres such that every row is within radius (a distance) of one, or `most` of them: the first row in the order, then ever the farthest one, ties in the order."""
    own = settled(rows.select("features", order.alias("o")))
    first = own.agg(F.min_by("features", "o").alias("f")).first()["f"]
    centres = [list(map(float, first))] if first is not None else []
    while centres and len(centres) < most:
        near = F.array_min(F.array(*[metric(distance)(F.col("features"), F.array(*map(F.lit, c))) for c in centres]))
        far = own.select("features", "o", near.alias("d")).agg(F.max(F.struct("d", (-F.col("o")).alias("o"), "features")).alias("m")).first()["m"]
        if far["d"] <= (radius**2 if distance == "l2" else radius):
            break
        centres.append(list(map(float, far["features"])))
    return centres


def recursive(rows: DataFrame, k: int, depth: int, least: int = 2, seed: int = 1) -> DataFrame:
    """rows with path: the words of a k-means in every cluster of the level above, joined by dots, down to a depth or to clusters under k * least rows.

    A level is one pass over the rows for each of its clusters, of which there are k^(depth-1) at most.
    """
    out = settled(rows.withColumn("path", F.lit("")))
    for level in range(depth):
        paths = [(r["path"], r["count"]) for r in out.groupBy("path").count().collect()]  # k^level clusters at most
        done = [p for p, n in paths if n < k * least or p.count(".") < level]
        parts = [out.filter(F.col("path").isin(done))] if done else []
        for p in sorted(p for p, _ in paths if p not in done):
            own = out.filter(F.col("path") == p)
            parts.append(assign(own, k_means(own, k, seed)).withColumn("path", F.concat(F.col("path"), F.lit("." if p else ""), F.col("word").cast("string"))).drop("word"))
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        out = settled(new)
    return out


def sampled(rows: DataFrame, key: str, share: int, cluster) -> DataFrame:
    """rows with word: centres come from cluster(sample), a sample of one row in `share` by a hash of the key, and all rows go to the nearest."""
    sample = rows.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0)
    return assign(rows, cluster(sample))


def by_graph(rows: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(node, component): rows (node, features) joined by those edges (src, dst) whose ends are within a distance of each other.

    With a least spanning tree as edges this cuts the tree where it is longer than that.
    """
    a, b = rows.toDF("src", "f"), rows.toDF("dst", "g")
    near = edges.select("src", "dst").join(a, "src").join(b, "dst").filter(squared_distance(F.col("f"), F.col("g")) <= most**2)
    return rows.select("node").join(graph.components(near.select("src", "dst")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def tree_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): a least spanning forest of the edges under the distances of their ends."""
    a, b = rows.toDF("src", "f"), rows.toDF("dst", "g")
    return graph.spanning_forest(edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", F.sqrt(squared_distance(F.col("f"), F.col("g"))).alias("w")))


class Session:
    """Rows added one table after the other, and clustered as they stand; clear() starts anew."""

    def __init__(self) -> None:
        self.rows: DataFrame | None = None

    def add(self, rows: DataFrame) -> None:
        self.rows = rows.select("features") if self.rows is None else self.rows.union(rows.select("features"))

    def clear(self) -> None:
        self.rows = None

    def centres(self, kind: str, **how) -> list[list[float]]:
        if self.rows is None:
            return []
        return {"k_means": k_means, "k_medians": k_medians, "covering": covering}[kind](self.rows, **how)


def cost(rows: DataFrame, centres: list[list[float]]) -> float:
    """The sum of squared distances to the nearest centres."""
    near = F.array_min(F.array(*[squared_distance(F.col("features"), F.array(*map(F.lit, c))) for c in centres]))
    return float(np.float64(rows.agg(F.sum(near)).first()[0] or 0.0))
