"""Photos, graphs, weights and reports as files of a shared folder: readers by template, and what is written once and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.operators.factors import Graphs


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def with_paths(index: DataFrame, template: str, **columns: str) -> DataFrame:
    """An index of photos with the path of each by a template such as folder/%06d.png, filled with the photo's number, or with other columns by name."""
    filled = F.format_string(template, *[F.col(columns.get(name, name)) for name in (columns or {"photo": "photo"})])
    return index.withColumn("path", filled)


def by_number(spark: SparkSession, folder: str, pattern: str = r"([0-9]+)\.[^/]*$") -> DataFrame:
    """All Parquet files of a folder in one table, each row with the number in its file's name."""
    return spark.read.parquet(folder).withColumn("photo", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("long"))


def overridden(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows, where a photo with rows in others has those instead."""
    return rows.join(others.select("photo").distinct(), "photo", "left_anti").unionByName(others.select(*rows.columns))


def similarities(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(c1, c2, s) of one metric of a table of class similarities (metric, c1, c2, s), both ways round."""
    own = spark.read.parquet(path).filter(F.col("metric") == metric).select("c1", "c2", "s")
    return own.union(own.select("c2", "c1", "s")).groupBy("c1", "c2").agg(F.max("s").alias("s"))


def save_dataset(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name; nothing that is there is overwritten."""
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_dataset(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def export_graphs(folder: str, train: Graphs, test: Graphs, weights: list[float], names: list[str] | None = None) -> None:
    """Training graphs, test graphs and the model side by side, to be learned or inferred elsewhere."""
    spark = train.packed.sparkSession
    model = [(i, float(w), names[i] if names else None, train.classes, train.n_weights) for i, w in enumerate(weights)]
    save_dataset({"train": train.packed, "test": test.packed, "model": spark.createDataFrame(model, "i int, weight double, name string, classes int, n_weights int")}, folder)


def import_graphs(spark: SparkSession, folder: str) -> tuple[Graphs, Graphs, list[float], list[str | None]]:
    model = sorted(spark.read.parquet(f"{folder}/model").collect(), key=lambda r: r["i"])  # a row a weight
    packed = [Graphs(spark.read.parquet(f"{folder}/{name}"), model[0]["classes"], model[0]["n_weights"]) for name in ("train", "test")]
    return packed[0], packed[1], [r["weight"] for r in model], [r["name"] for r in model]


def save_beliefs(folder: str, weights: list[float], beliefs: DataFrame) -> None:
    """Weights and beliefs (photo, region, state, belief) of a run."""
    spark = beliefs.sparkSession
    save_dataset({"weights": spark.createDataFrame(list(enumerate(map(float, weights))), "i int, weight double"), "beliefs": beliefs}, folder)


def read_beliefs(spark: SparkSession, folder: str) -> tuple[list[float], DataFrame]:
    rows = spark.read.parquet(f"{folder}/weights").collect()  # a row a weight
    return [r["weight"] for r in sorted(rows, key=lambda r: r["i"])], spark.read.parquet(f"{folder}/beliefs")


def evaluated(spark: SparkSession, folder: str, make) -> tuple[DataFrame, str]:
    """The report (class, precision, recall, iou) at folder, made by make() if it isn't there, and its text."""
    if not exists(spark, folder):
        make().write.mode("errorifexists").parquet(folder)
    rows = spark.read.parquet(folder)
    show = lambda v: "   -" if v is None else f"{100 * v:6.2f}"
    lines = [f"{r['class']!s:>16}  {show(r['precision'])}  {show(r['recall'])}  {show(r['iou'])}" for r in rows.orderBy("class").collect()]  # a row a class
    return rows, "\n".join([f"{'class':>16}  precis  recall     iou", *lines])


def masks(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """(photo, class, y, x) of the pixels (photo, y, x, t) of those classes (class): masks to be written for another program."""
    return pixels.join(classes.select(F.col("class").alias("t")), "t", "left_semi").select("photo", F.col("t").alias("class"), "y", "x")
