import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolith.functions import geometry as geo
from regiolith.functions import ranking, scalar
from regiolith.operators import boxes, learning, metrics, pairs, recognition, region, taxonomy


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_argmax_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0)], "i int, v double")
    assert df.agg(ranking.argmax(F.col("v"), F.col("i"))).first()[0] == 2
    assert df.agg(ranking.argmin(F.col("v"), F.col("i"))).first()[0] == 1


def test_boxes(spark):
    a, b = geo.box(*map(F.lit, (1.0, 1.0, 10.0, 10.0))), geo.box(*map(F.lit, (10.0, 10.0, 12.0, 12.0)))
    inclusive, exclusive = one(spark, geo.overlap(a, b), geo.overlap(a, b, inclusive=False))
    assert inclusive == pytest.approx(1 / 108) and exclusive == 0.0
    assert one(spark, geo.overlap(a, a))[0] == 1.0
    grown = one(spark, geo.grown(a, 2.0))[0]
    assert (grown["r0"], grown["r1"]) == (-3.5, 14.5)
    assert one(spark, geo.common(a, geo.box(*map(F.lit, (20.0, 20.0, 30.0, 30.0)))))[0] is None


def test_suppression_keeps_the_best():
    b = np.array([[[0, 0, 9, 9]], [[0, 0, 9, 8]], [[50, 50, 59, 59]]], float)
    assert boxes.greedy(b, np.array([1.0, 2.0, 0.5])).tolist() == [1, 2]


def test_scalars(spark):
    q = one(spark, scalar.hazen_quantile(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 0.85))[0]
    assert q == pytest.approx(3.9)
    assert one(spark, scalar.ratio(F.lit(1), F.lit(0)), scalar.share_of(F.lit(3.0), F.lit(0.0))) == (None, 3.0)
    assert one(spark, *scalar.direction(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == (0.0, -1.0)
    x = F.lit(7.0)
    assert one(spark, scalar.flip_x(scalar.flip_x(x, F.lit(9.0)), F.lit(9.0)), scalar.resize(x, 1.0))[:2] == (7.0, 7.0)
    assert one(spark, scalar.histogram_bin(F.lit(25.0), 0.0, 500.0, 11), scalar.histogram_bin(F.lit(9e9), 0.0, 500.0, 11)) == (0, 10)
    g = one(spark, scalar.gaussian2(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), 2.0, 5.0))[0]
    assert g == pytest.approx(1 / (2 * math.pi * math.sqrt(12 * 5)))


def test_metrics_skip_what_is_undefined(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (9, 1)], "t int, p int")
    k = spark.createDataFrame([(1,), (2,)], "class int")
    m = metrics.confusion(rows, k)
    assert m.agg(F.sum("n")).first()[0] == 3 and m.count() == 4
    by = {r["class"]: r for r in metrics.by_class(m).collect()}
    assert by[2]["precision"] is None and by[2]["recall"] == 0.0 and by[1]["precision"] == pytest.approx(2 / 3)
    assert metrics.summary(m).first()["precision"] == pytest.approx(2 / 3)


def test_classes(spark):
    rows, known = spark.createDataFrame([("a",), ("z",)], "raw string"), spark.createDataFrame([("a", 1)], "raw string, class int")
    assert taxonomy.relabel(rows, known, "raw").count() == 1
    with pytest.raises(Exception, match="no class"):
        taxonomy.relabel(rows, known, "raw", strict=True).collect()
    fine = spark.createDataFrame([(1, [1, 2]), (2, [3])], "class int, ids array<int>")
    assert {tuple(r) for r in taxonomy.bridge(fine, spark.createDataFrame([(7, [1, 2]), (8, [2, 3])], "class int, ids array<int>")).collect()} == {(1, 8), (2, 8)}


def test_pairs_and_priors(spark):
    grid = spark.createDataFrame([(1, y, x, s) for y, row in enumerate([[1, 1, 2], [3, 1, 2]]) for x, s in enumerate(row)], "photo int, y int, x int, seg int")
    assert {tuple(r)[1:] for r in pairs.adjacent(grid).collect()} == {(1, 1), (1, 2), (1, 3), (2, 2)}
    p = pairs.prior(spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "b", "a"), (2, "a", "a")], "g int, a string, b string"), ["g"])
    got = {(r["a"], r["b"]): r["p"] for r in p.collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(2 / 3)
    full = {(r["a"], r["b"]): r["p"] for r in pairs.fill_prior(p, spark.createDataFrame([("a",), ("b",)], "class string")).collect()}
    assert full["b", "b"] == pytest.approx(1 / 3)


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.normal(size=2) + (3 if i % 2 else -3)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, features array<double>, t int")
    best = learning.scores(df, learning.one_against_rest(df, [0, 1])).groupBy("id", "t").agg(ranking.argmax(F.col("score"), F.col("class")).alias("p"))
    assert best.filter("t = p").count() >= 79
    assert {r["n"] for r in learning.word_counts(learning.assign(df, learning.k_means(df, 2, restarts=2)), ["t"]).collect()} == {40}
    point, value = learning.simplex(lambda v: float((v[0] - 1) ** 2 + (v[1] + 2) ** 2), np.zeros(2), 120)
    assert value < 1e-4 and abs(point[0] - 1) < 0.05
    w = np.kron(np.eye(2), np.ones((3, 3))) + 0.01
    vector = learning.spectral(w, 1)[:, 0]
    assert len({bool(x > 0) for x in vector[:3]}) == 1 and (vector[0] > 0) != (vector[5] > 0)
    assert learning.cross_validate(df, ranking.fold(F.col("id") + 1, 4), 4, lambda x: x.count(), lambda n, x: n + x.count()) == 80
    assert learning.grid_search([{"a": 1}, {"a": 3}, {"a": 2}], lambda a: a) == ({"a": 3}, 3)


def test_recognition(spark):
    db = spark.createDataFrame([(1, 0, 0, [0.0, 0.0]), (2, 0, 0, [0.0, 1.0]), (3, 1, 0, [5.0, 5.0])], "id long, class int, exemplar int, features array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.4])], "query long, features array<double>")
    near = recognition.neighbours(q, db, 2)
    assert [r["id"] for r in near.orderBy("distance").collect()] == [1, 2]
    assert tuple(recognition.vote(near, db).first()) == (9, 0, pytest.approx(2 / math.sqrt(2), abs=1e-5))


def test_regions(spark):
    px = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, 2.0), (1, 2, 3, 1.0)], "photo int, seg int, t int, w double")
    assert {(r["seg"], r["t"]) for r in region.vote(px, region.REGION, "t", "w").collect()} == {(1, 1), (2, 3)}
    cells = region.cell_histogram(px.withColumn("y", F.lit(0)).withColumn("x", F.col("t")), ["photo"], F.col("y"), F.col("x"), "seg")
    assert {(r["cx"], r["block"]) for r in cells.collect()} == {(1, 2), (2, 2), (3, 1)}


def test_numbers_go_on_across_ranges(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v")).repartition(7)
    got = [r["i"] for r in ranking.numbered(df, ["v"], "i").orderBy("v").collect()]
    assert got == list(range(1, 101))
