"""Event streams: class frequencies and successive pairs in windows of event time.

Beyond the batch operators: the same aggregates over unbounded input, with a
watermark that bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regiolith.session import reach_workers


def read(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def frequency(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a longer pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def successive(events: DataFrame) -> DataFrame:
    """(user_id, a, b, n): pairs of event types that follow each other, across batches; a user's state is one event type."""
    reach_workers(events.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        kinds = ([state.get[0]] if state.exists else []) + pdf["event_type"].tolist()
        state.update((kinds[-1],))
        pairs = pd.DataFrame({"a": kinds[:-1], "b": kinds[1:]})
        if len(pairs):
            out = pairs.groupby(["a", "b"], as_index=False).size().rename(columns={"size": "n"})
            out.insert(0, "user_id", key[0])
            yield out

    own = events.select("user_id", "ts", "event_id", "event_type")
    return own.groupBy("user_id").applyInPandasWithState(run, "user_id long, a string, b string, n long", "last string", "append", GroupStateTimeout.NoTimeout)
