"""Classes: relabelling, maps between levels, dissimilarities, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.functions.scalar import ratio


def relabel(rows: DataFrame, taxonomy: DataFrame, raw: str, strict: bool = False) -> DataFrame:
    """Rows with class for their raw label, by taxonomy (raw, class); strict: an unknown label is an error, else its rows go."""
    known = taxonomy.select(F.col("raw").alias(raw), "class")
    if not strict:
        return rows.join(known, raw)
    found = rows.join(known, raw, "left")
    return found.withColumn("class", F.when(F.assert_true(F.col("class").isNotNull(), F.lit("a label has no class")).isNull(), F.col("class")))


def bridge(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(fine, target) pairs of classes (class, ids array) whose ids overlap but aren't the same."""
    a, b = fine.select(F.col("class").alias("fine"), F.array_sort(F.array_distinct("ids")).alias("f")), coarse.select(F.col("class").alias("target"), F.array_sort(F.array_distinct("ids")).alias("t"))
    shared = a.select("fine", F.explode("f").alias("id")).join(b.select("target", F.explode("t").alias("id")), "id").select("fine", "target").distinct()
    return shared.join(a, "fine").join(b, "target").filter(~(F.col("f") == F.col("t"))).select("fine", "target")


def dissimilarity(similar: DataFrame, background: float = 16.0) -> DataFrame:
    """(c1, c2, d): reciprocals of similarities (c1, c2, s), scaled to a least of 1; and class 0, background times the largest from all others."""
    d = similar.select("c1", "c2", ratio(F.lit(1.0), F.col("s")).alias("d"))
    ends = d.agg(F.min("d").alias("low"), F.max("d").alias("high"))
    scaled = d.join(F.broadcast(ends)).select("c1", "c2", ratio(F.col("d"), F.col("low")).alias("d"), (background * ratio(F.col("high"), F.col("low"))).alias("far"))
    classes = scaled.select(F.col("c1").alias("c"), "far").union(scaled.select("c2", "far")).distinct()
    zero = F.lit(0).cast(dict(similar.dtypes)["c1"])
    row = classes.select(zero.alias("c1"), F.col("c").alias("c2"), F.col("far").alias("d"))
    col = classes.select(F.col("c").alias("c1"), zero.alias("c2"), F.col("far").alias("d"))
    return scaled.select("c1", "c2", "d").union(row).union(col)


def roll_up(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(g1, g2, d): mean dissimilarity (c1, c2, d) over the block of two groups (class, grp)."""
    g = lambda c, n: groups.select(F.col("class").alias(c), F.col("grp").alias(n))
    return pairs.join(g("c1", "g1"), "c1").join(g("c2", "g2"), "c2").groupBy("g1", "g2").agg(F.avg("d").alias("d"))


def domain(names: DataFrame, known: DataFrame, always: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, name) of the names, with those that always belong, that are known (id, name); and the unknown names."""
    spark = names.sparkSession
    asked = names.select("name").union(spark.createDataFrame([(x,) for x in always], "name string") if always else names.select("name").limit(0)).distinct()
    return asked.join(known, "name").select("id", "name"), asked.join(known, "name", "left_anti")


def losses(segments: DataFrame, dissim: DataFrame, frequency: DataFrame, factor: float = 10.0) -> DataFrame:
    """(photo, seg, t, state, loss): dissimilarity from the truth t, times how much rarer t is than the commonest class; 0 at the truth."""
    most = frequency.agg(F.max("frequency").alias("most"))
    rare = frequency.join(F.broadcast(most)).select("t", (ratio(F.col("most"), F.col("frequency")) * factor).alias("rarity"))
    own = segments.join(rare, "t").join(dissim.select(F.col("c1").alias("t"), F.col("c2").alias("state"), "d"), "t")
    return own.select("photo", "seg", "t", "state", F.when(F.col("t") == F.col("state"), 0.0).otherwise(F.col("d") * F.col("rarity")).alias("loss"))


def class_weights(rows: DataFrame, label: Column) -> DataFrame:
    """(class, n, weight): all rows over the class's rows."""
    n = rows.groupBy(label.alias("class")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("class", "n", (F.col("total") / F.col("n")).alias("weight"))


def resolve(asked: DataFrame | bool, models: DataFrame, present: DataFrame) -> DataFrame:
    """(class) to consider: True: those of the models that are present, False: all models', else those of the models that are asked."""
    known = models.select("class").distinct()
    if asked is False:
        return known
    return known.join((present if asked is True else asked).select("class").distinct(), "class", "left_semi")


def names_of(rows: DataFrame, known: DataFrame, id_column: str) -> DataFrame:
    """rows with the name of their id, null where it has none; domain() goes the other way."""
    return rows.join(known.select(F.col("id").alias(id_column), "name"), id_column, "left")
