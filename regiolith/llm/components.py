"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import cut, lean, merged, prepare, tidy

#: Links that one task joins in a moment; rounds of shuffles would take many times as long for them.
ONE_TASK = 200_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()  # the roots of both ends take the smaller one
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, label):
            return node, node[label]
        label = new


def in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if len(b["a"])]
        if ends:
            node, component = least_reachable(*(np.concatenate(x) for x in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])

    return cut(links.select("a", "b").coalesce(1).mapInArrow(lean(run), "node long, component long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b), which are a table or a checkpoint; component is the smallest node reachable.

    ONE_TASK links or fewer are joined in one task.  Of more, each round gives a node the least label next to it and then the label of
    that label, so a path is covered in a number of rounds that grows with the
    logarithm of its length.  Rounds are checkpointed and end when nothing
    changes.  The smallest label of a node is a partial aggregate, so a hub with
    many links costs no task more than others.
    """
    prepare(links.sparkSession)
    if links.count() <= ONE_TASK:
        return in_one_task(links)
    both = cut(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = merged(both, labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = merged(labels, near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("next"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = cut(merged(step, jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), "was"))
        labels = new.select("node", "component")
        del near, step, jump
        tidy(links.sparkSession)
        if new.filter("component <> was").isEmpty():
            return labels
