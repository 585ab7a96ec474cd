"""Small entities many at a time, against the operators on one, and that no query calls Python or shuffles for each step of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolith.operators import factors, graph, learning, pairs
from regiolith.operators import small_graphs as s
from regiolith.plans import catalog, catalog_more  # noqa: F401
from regiolith.session import by_size, packed, per_batch

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def rings(n, many=20, seed=1):
    ends = [(i, i % n + 1) for i in range(1, n + 1)] + [(1, 3)]
    return ends, np.random.default_rng(seed).integers(1, 50, (many, n + 1)).astype(float)


def test_packed_entities_come_back_whole(spark):
    rows = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, 7.0), (3, 1, None)], "photo long, seg int, q double")

    def run(photo, offsets, cols):
        assert sum(len(which) * n for n, which, _ in by_size(offsets)) == len(cols["seg"])
        return {"photo": np.repeat(photo, np.diff(offsets)), "seg": cols["seg"], "q": cols["q"]}

    got = per_batch(packed(rows, "photo", "seg", "q"), run, "photo long, seg int, q double").collect()
    assert [(r.photo, r.seg) for r in sorted(got)] == [(1, 1), (1, 2), (2, 1), (3, 1)] and {r.q for r in got if r.photo < 3} == {4.0, 5.0, 7.0}


@pytest.mark.parametrize("n", [2, 3, 6, 11])
def test_chains_many_at_a_time(n):
    q = np.random.default_rng(n).integers(1, 12, (60, n)).astype(float)
    w = np.abs(np.diff(q, axis=1))
    for own, got in zip(w, s.segment_chains(w, 4.0)):
        assert s.segments(n, [(i, i + 1, float(x)) for i, x in enumerate(own)], 4.0) == got.tolist()
    for own, *got in zip(q.tolist(), *s.merge_chains(q)):
        whole = s.merge_hierarchy(own, {(i, i + 1): 1 - (own[i] + own[i + 1]) / sum(own) for i in range(n - 1)}, lambda a, b, t: 1 - (a + b) / t)
        assert [m[:3] for m in whole] == list(zip(*[x.tolist() for x in got]))


@pytest.mark.parametrize("n", [5, 8, 12])
def test_graphs_of_one_shape(n):
    ends, weight = rings(n)
    rng = random.Random(n)
    other = [tuple(rng.sample(range(n), 2)) for _ in range(2 * n)] + [(0, 0)]
    for ends, weight, source, sink in ((ends, weight, 1, n), (other, np.random.default_rng(n).integers(1, 9, (5, len(other))).astype(float), 0, n - 1)):
        for w, heavy, cut in zip(weight, s.heaviest_matchings(ends, weight), s.least_cuts(ends, weight, source, sink)):
            edges = [(*e, float(x)) for e, x in zip(ends, w)]
            assert heavy == sum(edges[i][2] for i in s.max_matching(edges))
            assert cut == s.max_flow(edges, source, sink)[0] == sum(edges[i][2] for i in s.min_cut(edges, source, sink))


def test_hierarchy_sums(spark):
    schema = "photo int, node int, parent int, v double"
    merges = spark.createDataFrame([(1, 1, 4, 1.0), (1, 2, 4, 2.0), (1, 3, 5, 4.0), (1, 4, 5, None), (2, 7, 9, 1.0), (2, 8, 9, 5.0)], schema)
    assert {tuple(r) for r in graph.hierarchy_sums(merges, "v").collect()} == {(1, 4, 2, 3.0), (1, 5, 3, 7.0), (2, 9, 2, 6.0)}
    with pytest.raises(Exception, match="other than two parts"):
        graph.hierarchy_sums(merges.filter("node <> 3"), "v").collect()
    with pytest.raises(Exception, match="cycle"):
        graph.hierarchy_sums(spark.createDataFrame([(1, 1, 3, 1.0), (1, 4, 3, None), (1, 2, 4, 1.0), (1, 3, 4, None)], schema), "v").collect()


def test_pairs_by_one_shuffle(spark):
    own = spark.createDataFrame([(p, i, (p * 7 + i * 5) % 11) for p in range(4) for i in (1, 2, 3, 5)], "photo int, seg int, q int")
    near = own.select("photo", F.col("seg").alias("s1"), (F.col("seg") + 1).alias("s2"))
    for got, want in ((pairs.met(own, ["q"]), pairs.gather(pairs.unordered(own), own, ["q"])), (pairs.neighbours(own, ["q"]), pairs.gather(near, own, ["q"]))):
        cols = ["photo", "s1", "s2", "q_1", "q_2"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_blobs_take_one_shuffle_and_no_loop(spark):
    df = catalog.QUERIES["blob_hierarchy"](spark, FOLDER)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and "Scan ExistingRDD" not in physical


@pytest.mark.parametrize("name", ["similarity_forest", "small_graph_problems", "merge_groups", "region_segment"])
def test_no_python_call_for_each_order(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text


def test_forest_of_repeated_pairs(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.95), (1, 1, 3, 0.99), (2, 1, 2, 0.9), (2, 1, 2, 0.97), (3, 1, 2, 0.1)], "photo int, s1 int, s2 int, p double")
    assert {tuple(r) for r in factors.similar_pairs(rows).collect()} == {(1, 2, 3, 0.95), (1, 1, 3, 0.99), (2, 1, 2, 0.97)}


def test_same_label_has_rows_without_a_label(spark):
    rows = spark.createDataFrame([(i, 1, 2, [float(i % 3), 1.0], None if i == 7 else int(i % 3 > 0)) for i in range(40)], "photo int, s1 int, s2 int, features array<double>, same int")
    found, _ = learning.same_label(rows, F.col("photo") < 30, least=0.0)
    assert found.count() == 40


def test_mixture_is_sparks(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 1, (60, 3)), draw.normal(3, 0.5, (40, 3))])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    model = learning.Mixture(k=2, least=0.0).fit(rows)
    want = GaussianMixture(k=2, seed=1).fit(rows.select(array_to_vector("features").alias("features")))
    for (w, own), share, mean in zip(model.parts, want.weights, want.gaussians):
        assert w == pytest.approx(share, abs=1e-6) and own.mean == pytest.approx(mean.mean.toArray(), abs=1e-5)
    got = [r.v for r in rows.select(model.value(F.col("features")).alias("v")).collect()]
    assert got == pytest.approx([sum(w * own.scale * np.exp(-0.5 * (v - own.mean) @ own.inverse @ (v - own.mean)) for w, own in model.parts) for v in x])


def test_mixture_of_wide_rows_is_no_expression_of_all_products(spark):
    model = learning.Mixture()
    model.parts = [(1.0, learning.Normal())]
    model.parts[0][1].mean, model.parts[0][1].inverse = np.zeros(64), np.eye(64)
    assert len(str(model.value(F.col("features")))) < 1000


def test_same_label_shuffles_no_rows_by_label(spark):
    seen = []

    class Watched(learning.Logistic):
        def fit(self, rows):
            seen.append(plan(rows))
            return [0.0, 0.0], 0.0

    rows = spark.createDataFrame([(i, 1, 2, [float(i % 3), 1.0], int(i % 3 > 0)) for i in range(40)], "photo int, s1 int, s2 int, features array<double>, same int")
    learning.same_label(rows, F.col("photo") < 30, Watched, least=0.0)
    assert "Join" not in seen[0] and "Exchange" not in seen[0]
