"""Session defaults, checkpoints, and grouped Python."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(name: str = "regiolith", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ANSI stays on."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver found it."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder, without the size estimates of its plan, which grow without end in loops."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="regiolith-"))  # one machine: tests
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of queries that are done; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def per_group(df: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """function(pandas frame of one entity) -> pandas frame, for entities that each fit a task."""
    reach_workers(df.sparkSession)
    return df.groupBy(*by).applyInPandas(function, schema)


def packed(df: DataFrame, by: str, *cols: Column | str) -> DataFrame:
    """(by, own): each entity as one row, own: the structs of these columns in their order.  An entity fits a row."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("own"))


def per_batch(entities: DataFrame, function: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """function over many of packed()'s rows at once, as a Python call each costs more than the work on small entities.

    It gets the entities' names, the offsets of their structs, and the structs' columns, and returns columns.
    """
    reach_workers(entities.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets, own = lists.offsets.to_numpy(), lists.flatten()
            cols = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(own.type, own.flatten())}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in function(b.column(0).to_numpy(zero_copy_only=False), offsets - offsets[0], cols).items()})

    return entities.mapInArrow(run, schema)


def by_size(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, which, at) of the entities of n structs each: their places, and the places of their structs, one row an entity."""
    lens = np.diff(offsets)
    for n in np.unique(lens).tolist():
        which = np.flatnonzero(lens == n)
        yield n, which, offsets[which][:, None] + np.arange(n)
