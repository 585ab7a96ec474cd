"""Factor graphs as files: a text format, a binary one, observations, and libsvm rows.

Text, one sample a file: a line MARKOV; the number of variables; their
cardinalities; their machines; then a line for each region: its number, counting
number, variables (count, ids), features (count, then id and one value a state
each), the loss of each state, parents (count, ids).  All numbers from 0.
Observations: a count and the states, -1 where latent.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.operators.crf import Region
from regiolith.session import reach_workers

HEADER = "MARKOV"
SCHEMA = "path string, kind string, region int, count double, items array<int>, feature int, state int, value double"


def parse(text: str) -> dict:
    """cardinalities, machines and regions (count, variables, features {id: values}, loss, parents) of a text."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or lines[0].strip() != HEADER:
        raise ValueError("the header is missing")
    out = {"cardinalities": [int(x) for x in lines[2].split()], "machines": [int(x) for x in lines[3].split()], "regions": []}
    if len(out["cardinalities"]) != int(lines[1]):
        raise ValueError("the number of variables doesn't fit")
    for line in lines[4:]:
        at = iter(line.split())
        take = lambda n, kind: [kind(next(at)) for _ in range(n)]  # noqa: B023, E731
        take(1, int)
        count = float(next(at))
        variables = take(int(next(at)), int)
        states = int(np.prod([out["cardinalities"][v] for v in variables]))
        features = {}
        for _ in range(int(next(at))):
            f = int(next(at))
            features[f] = take(states, float)
        out["regions"].append({"count": count, "variables": variables, "features": features, "loss": take(states, float), "parents": take(int(next(at)), int)})
    return out


def write_text(sample: dict) -> str:
    """The text of what parse() returns."""
    words = lambda x: " ".join(map(str, x))
    lines = [HEADER, str(len(sample["cardinalities"])), words(sample["cardinalities"]), words(sample["machines"])]
    for i, r in enumerate(sample["regions"]):
        features = " ".join(f"{f} {words(f'{v:.6f}' for v in values)}" for f, values in r["features"].items())
        lines.append(" ".join(x for x in (str(i), f"{r['count']:.6f}", str(len(r["variables"])), words(r["variables"]), str(len(r["features"])), features, words(f"{v:.6f}" for v in r["loss"]), str(len(r["parents"])), words(r["parents"])) if x))
    return "\n".join(lines) + "\n"


def write_binary(sample: dict) -> bytes:
    """The same in little-endian int32 and float64."""
    out = [b"MRKB"]
    ints = lambda *x: out.append(struct.pack(f"<{len(x)}i", *x))
    reals = lambda *x: out.append(struct.pack(f"<{len(x)}d", *x))
    ints(len(sample["cardinalities"]), *sample["cardinalities"], *sample["machines"], len(sample["regions"]))
    for r in sample["regions"]:
        reals(r["count"])
        ints(len(r["variables"]), *r["variables"], len(r["features"]))
        for f, values in r["features"].items():
            ints(f)
            reals(*values)
        reals(*r["loss"])
        ints(len(r["parents"]), *r["parents"])
    return b"".join(out)


def parse_binary(data: bytes) -> dict:
    if data[:4] != b"MRKB":
        raise ValueError("the header is missing")
    at = 4

    def take(kind: str, n: int) -> list:
        nonlocal at
        out = list(struct.unpack_from(f"<{n}{kind}", data, at))
        at += n * (4 if kind == "i" else 8)
        return out

    n = take("i", 1)[0]
    out = {"cardinalities": take("i", n), "machines": take("i", n), "regions": []}
    for _ in range(take("i", 1)[0]):
        count = take("d", 1)[0]
        variables = take("i", take("i", 1)[0])
        states = int(np.prod([out["cardinalities"][v] for v in variables]))
        features = {take("i", 1)[0]: take("d", states) for _ in range(take("i", 1)[0])}
        out["regions"].append({"count": count, "variables": variables, "features": features, "loss": take("d", states), "parents": take("i", take("i", 1)[0])})
    return out


def regions(sample: dict, weights: np.ndarray, loss: bool = False) -> list[Region]:
    """Regions with potentials sum of weight * feature, and the loss in training only."""
    out = []
    for r in sample["regions"]:
        table = np.array(r["loss"]) if loss else np.zeros(len(r["loss"]))
        for f, values in r["features"].items():
            table = table + weights[f] * np.array(values)
        shape = [sample["cardinalities"][v] for v in r["variables"]]
        out.append(Region(tuple(r["variables"]), table.reshape(shape, order="F"), r["count"], list(r["parents"])))
    return out


def read(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """Samples as long rows: kind var (region: variable, count: cardinality, feature: machine), region (items: variables), parent (items), feature and loss (by state)."""
    reach_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                s = parse_binary(bytes(data)) if binary else parse(bytes(data).decode())
                out += [(name, "var", i, float(c), None, m, None, None) for i, (c, m) in enumerate(zip(s["cardinalities"], s["machines"]))]
                for i, r in enumerate(s["regions"]):
                    out += [(name, "region", i, r["count"], r["variables"], None, None, None), (name, "parent", i, None, r["parents"], None, None, None)]
                    out += [(name, "feature", i, None, None, f, x, v) for f, values in r["features"].items() for x, v in enumerate(values) if v]
                    out += [(name, "loss", i, None, None, None, x, v) for x, v in enumerate(r["loss"]) if v]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"feature": "Int32", "state": "Int32"})

    return files.mapInPandas(rows, SCHEMA)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(path, variable, state) with null for latent variables; built-in functions only."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    numbers = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    states = text.select("path", F.posexplode(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0)))).alias("variable", "s"))
    return states.select("path", "variable", F.when(F.col("s").cast("int") >= 0, F.col("s").cast("int")).alias("state"))


def read_libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(n_features)) if n_features else reader).load(path)


def write_libsvm(rows: DataFrame, path: str) -> None:
    """rows: label, features (vector)."""
    rows.select("label", "features").write.mode("errorifexists").format("libsvm").save(path)


def materialised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def assembled(photos: DataFrame, tables: dict[str, DataFrame], on: list[str], wanted: set[str]) -> DataFrame:
    """photos with the columns of each wanted table that has the key; the others are never read."""
    for name, t in tables.items():
        if name in wanted:
            photos = photos.join(t, on, "left")
    return photos
