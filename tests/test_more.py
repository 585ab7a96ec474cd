"""Library operators against plain versions: factor graphs, grids, poses, clusterers, matrices, densities, files."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolith.functions import ranking, scalar
from regiolith.operators import clusterers, crf, factors, graph, grids, learning, matrix, metrics, poses, recognition, taxonomy
from regiolith.sources import store


def value(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---------------------------------------------------------------- factor graphs


def tables(spark, photos=3, segments=3, classes=2, seed=1):
    rng = random.Random(seed)
    seg = [(p, s) for p in range(photos) for s in range(1, segments + 1)]
    scores = [(p, s, c, rng.random()) for p, s in seg for c in range(1, classes + 1)]
    pairs = [(p, s, s + 1, rng.random()) for p in range(photos) for s in range(1, segments)]
    truth = [(p, s, rng.randint(1, classes)) for p, s in seg]
    segs = spark.createDataFrame(seg, "photo int, seg int")
    near = spark.createDataFrame(pairs, "photo int, s1 int, s2 int, p double")
    features = factors.by_class(spark.createDataFrame(scores, "photo int, seg int, class int, value double"), 1.0, 0).union(factors.pair_potentials(near, classes, 1.0, classes))
    observed = spark.createDataFrame(truth, "photo int, seg int, class int").select("photo", factors.segment_name(F.col("seg")).alias("var"), (F.col("class") - 1).alias("state"))
    graphs = factors.Graphs.pack(factors.regions_of(segs, near), features, classes, classes + 1, observed=observed)
    return graphs, scores, pairs, truth


def energy(states, photo, scores, pairs, w, classes):
    total = sum(w[c - 1] * v for p, s, c, v in scores if p == photo and states[s - 1] == c - 1)
    return total + sum(w[classes] * v for p, a, b, v in pairs if p == photo and states[a - 1] == states[b - 1])


def test_beliefs_and_decoding_on_chains_are_exact(spark):
    graphs, scores, pairs, _ = tables(spark)
    w = np.array([1.5, -0.5, 0.8])
    got = {(r["photo"], r["region"], r["state"]): r["belief"] for r in factors.infer(graphs, w, bethe=True).collect()}
    best = {(r["photo"], r["seg"]): r["class"] for r in factors.decode(factors.infer(graphs, w, bethe=True)).collect()}
    for photo in range(3):
        weight = {s: math.exp(energy(s, photo, scores, pairs, w, 2)) for s in product(range(2), repeat=3)}
        z = sum(weight.values())
        for i in range(3):
            p = [sum(v for s, v in weight.items() if s[i] == k) / z for k in range(2)]
            assert all(abs(got[photo, f"s{i + 1}", k] - p[k]) < 1e-6 for k in range(2))
            assert best[photo, i + 1] == 1 + int(p[1] > p[0])


def test_learning_follows_its_gradient(spark):
    graphs, scores, pairs, truth = tables(spark, photos=2)
    states = {p: tuple(c - 1 for q, _, c in truth if q == p) for p in range(2)}

    def objective(w):
        out = 0.5 * float((w**2).sum())
        for p in range(2):
            out += math.log(sum(math.exp(energy(s, p, scores, pairs, w, 2)) for s in product(range(2), repeat=3))) - energy(states[p], p, scores, pairs, w, 2)
        return out

    w, path = factors.learn(graphs, np.ones(3), rounds=3, bethe=True)
    assert path == sorted(path, reverse=True)
    assert abs(path[0] - objective(np.ones(3))) < 1e-5 and abs(path[-1] - objective(w)) < 1e-5
    again = factors.learn_latent(graphs, np.ones(3), outer=1, rounds=3, bethe=True)  # all is observed, so nothing is completed
    assert np.allclose(again, w, atol=1e-4)


def test_latent_variables_are_completed(spark):
    graphs, *_ = tables(spark, photos=2)
    part = factors.Graphs(graphs.packed.withColumn("observed", F.expr("filter(observed, x -> x.var <> 's2')")), 2, 3)
    w = factors.learn_latent(part, np.ones(3), outer=2, rounds=2, bethe=True)
    assert np.isfinite(w).all() and not np.allclose(w, 1)


def test_failing_graphs_have_zeros(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "photo int, v double")
    build = lambda pdf: [crf.Region((0,), np.array([pdf["v"].iloc[0], 0.0]))]
    got = {(r["photo"], r["state"]): r["belief"] for r in crf.graph_beliefs(rows, build).collect()}
    assert abs(got[1, 0] - 1 / (1 + math.exp(-0.5))) < 1e-9 and got[2, 0] == got[2, 1] == 0.0

    def broken(pdf):
        raise KeyError("no such thing")

    assert [(r["region"], r["belief"]) for r in crf.graph_beliefs(rows.limit(1), broken).collect()] == [(-1, 0.0)]


def test_graphs_weights_and_beliefs_come_back(spark, tmp_path):
    graphs, *_ = tables(spark)
    store.export_graphs(str(tmp_path / "g"), graphs, graphs, [1.0, 2.0, 3.0], ["a", "b", "c"])
    train, test, w, names = store.import_graphs(spark, str(tmp_path / "g"))
    assert w == [1.0, 2.0, 3.0] and names == ["a", "b", "c"] and train.n_weights == 3
    beliefs = factors.infer(test, np.array(w))
    store.save_beliefs(str(tmp_path / "b"), w, beliefs)
    again, rows = store.read_beliefs(spark, str(tmp_path / "b"))
    assert again == w and rows.count() == beliefs.count()


def test_reports_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 0.5, None, 0.25)], "class int, precision double, recall double, iou double")

    for _ in range(2):
        rows, text = store.evaluated(spark, str(tmp_path / "r"), make)
    assert made == [1] and rows.count() == 1 and "50.00" in text and "-" in text


def test_readers_by_template_and_number(spark, tmp_path):
    paths = store.with_paths(spark.createDataFrame([(7,)], "photo long"), "maps/%06d.png").first()["path"]
    assert paths == "maps/000007.png"
    for i in (1, 2):
        spark.createDataFrame([(i * 10,)], "seg int").coalesce(1).write.parquet(str(tmp_path / f"{i}.parquet"))
    own = store.by_number(spark, str(tmp_path / "*.parquet"), r"([0-9]+)\.parquet/[^/]*$")
    assert {tuple(r) for r in own.select("photo", "seg").collect()} == {(1, 10), (2, 20)}
    new = store.overridden(own.select("photo", "seg"), spark.createDataFrame([(2, 99)], "photo long, seg int"))
    assert {tuple(r) for r in new.collect()} == {(1, 10), (2, 99)}
    spark.createDataFrame([("wup", 1, 2, 0.5), ("path", 1, 2, 0.1)], "metric string, c1 int, c2 int, s double").write.parquet(str(tmp_path / "sim"))
    assert {tuple(r) for r in store.similarities(spark, str(tmp_path / "sim"), "wup").collect()} == {(1, 2, 0.5), (2, 1, 0.5)}


# ---------------------------------------------------------------- grids


def test_envelopes_are_least_sums():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        f, (a, b) = rng.normal(size=n) * 5, (float(rng.uniform(0.05, 2)), float(rng.normal()))
        got, at = grids.envelope(f, a, b)
        table = np.array([[a * (q - p) ** 2 + b * (q - p) + f[p] for p in range(n)] for q in range(n)])
        assert np.allclose(got, table.min(axis=1)) and np.allclose(table[np.arange(n), at], got)


def test_runs_and_filters(spark):
    runs = spark.createDataFrame([(1, 2, [5.0, 6.0]), (1, 6, [7.0])], "photo int, start int, values array<double>")
    got = grids.runs_dense(runs, ["photo"], spark.createDataFrame([(1, 7)], "photo int, n int")).orderBy("position").collect()
    assert [r["value"] for r in got] == [0.0, 5.0, 6.0, 0.0, 0.0, 7.0, 0.0]
    bank = grids.gabor(1.41, 0.0)
    assert len(bank) == 11 * 11 and abs(sum(w for *_, w in bank)) < 1e-9  # odd about its axis
    one = spark.createDataFrame([(1, y, x, float(y == 1 and x == 1)) for y in range(3) for x in range(3)], "photo int, y int, x int, value double")
    seen = {(r["y"], r["x"]): r["value"] for r in grids.filtered(one, {"f": [(0, 0, 2.0), (0, 1, 1.0)]}).collect()}
    assert seen[1, 1] == 2.0 and seen[1, 0] == 1.0 and seen[0, 0] == 0.0


# ---------------------------------------------------------------- poses and colours


def test_mirrors_polygons_and_crossings(spark):
    joints = spark.createDataFrame([(1, "left_hand", 3.0, 1.0), (1, "neck", 5.0, 2.0)], "photo int, joint string, x double, y double")
    once = poses.mirrored(joints, F.lit(10.0))
    assert {(r["joint"], r["x"]) for r in once.collect()} == {("right_hand", 8.0), ("neck", 6.0)}
    assert sorted(map(tuple, poses.mirrored(once, F.lit(10.0)).collect())) == sorted(map(tuple, joints.collect()))
    assert poses.augmented(joints, F.lit(10.0), 100).count() == 4
    corners = value(spark, F.array(*poses.limb_polygon(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(1.0))).alias("c"))["c"]
    assert {(round(c["x"], 9), round(c["y"], 9)) for c in corners} == {(1.0, 0.0), (-1.0, 0.0), (1.0, 4.0), (-1.0, 4.0)}
    cross = lambda p, q: value(spark, poses.crossing([F.lit(float(x)) for x in p], [F.lit(float(x)) for x in q]).alias("v"))["v"]
    assert cross((0, 0, 2, 2), (0, 2, 2, 0)) and cross((0, 0, 2, 0), (1, 0, 3, 0)) and cross((0, 0, 1, 0), (1, 0, 1, 5))
    assert not cross((0, 0, 1, 1), (2, 2, 3, 3)) and not cross((0, 0, 2, 0), (0, 1, 2, 1))


def test_sticks_are_turned_to_the_nearer_end(spark):
    truth = [F.lit(float(x)) for x in (0, 0, 10, 0)]
    right = lambda *f: value(spark, metrics.sticks_right(truth, [F.lit(float(x)) for x in f]).alias("v"))["v"]
    assert right(0, 0, 10, 0) and right(10, 0, 0, 0) and right(10, 1, 1, 1) and not right(5, 8, 5, -8) and not right(30, 0, 40, 0)
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, None), (2, 2, None)], "photo int, part int, right boolean")
    got = {r["part"]: (r["detection_rate"], r["pcp"], r["part_rate"]) for r in metrics.detection_rates(rows).collect()}
    assert got == {1: (0.5, 0.5, 1.0), 2: (0.5, 0.5, 0.0)}


def test_known_colours(spark):
    lab = lambda *c: [value(spark, x.alias("v"))["v"] for x in scalar.srgb_to_cielab(*[F.lit(float(v)) for v in c])]
    assert np.allclose(lab(1, 1, 1), [100, 0, 0], atol=0.02) and np.allclose(lab(1, 0, 0), [53.23, 80.11, 67.22], atol=0.02) and np.allclose(lab(0, 0, 0), [0, 0, 0], atol=1e-6)
    back = scalar.xyz_to_srgb(*scalar.cielab_to_xyz(*scalar.srgb_to_cielab(F.lit(0.2), F.lit(0.5), F.lit(0.8))))
    assert np.allclose([value(spark, x.alias("v"))["v"] for x in back], [0.2, 0.5, 0.8], atol=1e-3)


# ---------------------------------------------------------------- graphs


def test_strong_components_of_random_digraphs(spark):
    rng = random.Random(4)
    edges = list({(rng.randrange(25), rng.randrange(25)) for _ in range(40)})
    reach = {v: {v} for e in edges for v in e}
    for _ in range(25):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    assert {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()} == want


def test_hierarchies(spark):
    merges = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (1, 3, 5), (1, 4, 5)], "photo int, node int, parent int")
    assert {(r["node"], r["leaf"]) for r in graph.hierarchy_leaves(merges).collect()} == {(4, 1), (4, 2), (5, 1), (5, 2), (5, 3)}
    with pytest.raises(Exception, match="two parts"):
        graph.hierarchy_leaves(merges.filter("node <> 3")).collect()


# ---------------------------------------------------------------- clusterers, densities, classifiers


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def test_medians_and_coverings(spark):
    rows = vectors(spark, [(0, 0), (1, 0), (10, 0), (100, 100), (101, 100), (130, 90)])
    assert clusterers.k_medians(rows, 2, [[0.0, 0.0], [90.0, 90.0]]) == [[1.0, 0.0], [101.0, 100.0]]
    found = clusterers.covering(rows, 15.0, 10, F.col("id"))
    assert found == [[0.0, 0.0], [130.0, 90.0], [100.0, 100.0]]
    assert clusterers.covering(rows, 0.0, 2, F.col("id")) == found[:2]
    paths = clusterers.recursive(rows, 2, 2, least=2)
    assert paths.count() == 6 and len({r["path"].split(".")[0] for r in paths.collect()}) == 2
    session = clusterers.Session()
    session.add(rows)
    assert len(session.centres("k_means", k=2)) == 2 and clusterers.cost(rows, [[0.0, 0.0], [100.0, 100.0]]) == 1 + 100 + 1 + 1000
    session.clear()
    assert session.centres("covering", radius=1.0, most=1, order=F.lit(1)) == []
    nodes = rows.select(F.col("id").alias("node"), "features")
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a + 1, 6)], "src long, dst long")
    tree = clusterers.tree_of(nodes, edges)
    assert tree.count() == 5
    assert {r["node"]: r["component"] for r in clusterers.by_graph(nodes, tree, 20.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_densities(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2)) @ np.array([[2.0, 0.3], [0.0, 1.0]])
    rows = vectors(spark, x)
    model = learning.Normal(least=0.0).fit(rows)
    got = [r["v"] for r in rows.select("id", model.value(F.col("features")).alias("v")).orderBy("id").collect()]
    cov, mean = np.cov(x.T), x.mean(axis=0)
    want = [math.exp(-0.5 * (v - mean) @ np.linalg.inv(cov) @ (v - mean)) / (2 * math.pi * math.sqrt(np.linalg.det(cov))) for v in x]
    assert np.allclose(got, want)
    few = learning.Mixture().fit(vectors(spark, [(1.0, 2.0, 3.0), (2.0, 1.0, 0.0)]))
    assert len(few.parts) == 1
    assert learning.Mixture(k=2).fit(rows).parts[0][0] < 1


def test_margins_and_pairs(spark):
    rows = spark.createDataFrame([([float(i % 2), float(i % 3)], i % 2) for i in range(40)], "features array<double>, t int")
    models = learning.one_against_rest(rows, [0, 1], learning.Margin)
    best = learning.scores(rows, models, floor=False).groupBy("t", "features").agg(ranking.argmax(F.col("score"), F.col("class")).alias("p"))
    assert best.filter("t <> p").isEmpty()
    pairs = spark.createDataFrame([(i % 4, 1, 2, [float(i % 2), 0.0], i % 2) for i in range(40)], "photo int, s1 int, s2 int, features array<double>, same int")
    found, _ = learning.same_label(pairs, F.col("photo") < 2)
    assert found.count() == 20 and all(r["p"] > 0.5 for r in found.collect())


def test_matrices(spark):
    a = np.array([[2.0, 1.0, -1.0, 8.0], [-3.0, -1.0, 2.0, -11.0], [-2.0, 1.0, 2.0, -3.0]])
    assert np.allclose(matrix.eliminated(a), [[1, 0, 0, 2], [0, 1, 0, 3], [0, 0, 1, -1]])
    assert matrix.rank(np.array([[1.0, 2.0], [2.0, 4.0]])) == 1 and matrix.rank(np.eye(3)) == 3
    cells = spark.createDataFrame([(1, i, j, float(3 * i + j)) for i in range(2) for j in range(3)], "m int, i int, j int, value double")
    assert {(r["i"], r["j"]): r["value"] for r in matrix.transposed(cells).collect()}[2, 1] == 5.0
    assert {r["place"] for r in matrix.found(cells, F.col("value") > 3).collect()} == {3, 5}
    assert matrix.threshold(spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double"), "v", 0.05) == 5.0
    u = [r["u"] for r in spark.range(2000).repartition(7).select(matrix.uniform(F.col("id"), 3).alias("u")).collect()]
    assert 0.45 < np.mean(u) < 0.55 and 0 <= min(u) and max(u) < 1
    z = [r["z"] for r in spark.range(2000).select(matrix.normal(F.col("id"), 3).alias("z")).collect()]
    assert abs(np.mean(z)) < 0.1 and abs(np.std(z) - 1) < 0.1


def test_queries_come_in_blocks(spark, monkeypatch):
    database = vectors(spark, [(i, i % 3) for i in range(40)]).select("id", (F.col("id") % 2).alias("class"), F.lit(0).alias("exemplar"), "features")
    asked = vectors(spark, [(3.2, 0), (20.1, 1), (7.0, 2)]).select(F.col("id").alias("query"), "features")
    want = sorted(map(tuple, recognition.neighbours(asked, database, 4).collect()))
    monkeypatch.setattr(recognition, "BLOCK_BYTES", 16)
    assert sorted(map(tuple, recognition.neighbours(asked, database, 4).collect())) == want and len(want) == 12


def test_domains(spark):
    models = spark.createDataFrame([(1,), (2,), (3,)], "class int")
    present = spark.createDataFrame([(2,), (9,)], "class int")
    ids = lambda df: {r["class"] for r in df.collect()}
    assert ids(taxonomy.resolve(True, models, present)) == {2} and ids(taxonomy.resolve(False, models, present)) == {1, 2, 3}
    assert ids(taxonomy.resolve(spark.createDataFrame([(3,), (4,)], "class int"), models, present)) == {3}


def test_quantiles_count_equal_values(spark):
    v = [5, 5, 5, 1, 2, 9, 9, 3, 5, 7]
    got = ranking.quantiles(spark.createDataFrame([(1, float(x)) for x in v], "g int, x double"), ["g"], "x", 0.85, "q").first()["q"]
    s, h = sorted(v), 0.85 * 10 + 0.5
    assert got == s[int(h) - 1] + (h - int(h)) * (s[int(h)] - s[int(h) - 1])


def test_kernel_machines_learn_what_lines_cannot(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (160, 2))
    y = np.sign(x[:, 0] * x[:, 1])
    for k in (learning.kernel("radial", gamma=4.0), learning.kernel("polynomial", shift=1.0, degree=2)):
        machine = learning.KernelMachine(k, cost=10.0).fit(x[:120], y[:120])
        assert (np.sign(machine.value(x[120:])) == y[120:]).mean() > 0.85
    line = learning.KernelMachine(learning.kernel("linear"), cost=10.0).fit(x[:120], y[:120])
    assert (np.sign(line.value(x[120:])) == y[120:]).mean() < 0.75
    rows = spark.createDataFrame([(i % 2, i, v.tolist(), float(t) if i < 120 else None) for i, (v, t) in enumerate(zip(x, y))], "g int, id int, features array<double>, label double")
    assert learning.kernel_scores(rows, ["g"], learning.KernelMachine(learning.kernel("radial", gamma=4.0))).count() == 160


def test_a_ladder_is_learned(spark):
    """Two samples of a ladder of eight binary variables: a weight a variable, one for all ten edges."""
    edges = [(i, i + 1) for i in (1, 2, 3, 5, 6, 7)] + [(i, i + 4) for i in range(1, 5)]
    seen = [1, 1, 2, 2, 2, 2, 1, 1]
    segs = spark.createDataFrame([(p, s) for p in (0, 1) for s in range(1, 9)], "photo int, seg int")
    near = spark.createDataFrame([(p, a, b, 1.0) for p in (0, 1) for a, b in edges], "photo int, s1 int, s2 int, p double")
    rows = [(p, f"s{s}", s - 1, k, 1.0 - 2 * k) for p in (0, 1) for s in range(1, 9) for k in (0, 1)]
    rows += [(p, f"p{a}-{b}", 8, i + 2 * j, 1.0 if i == j else -1.0) for p in (0, 1) for a, b in edges for i in (0, 1) for j in (0, 1)]
    features = spark.createDataFrame(rows, "photo int, region string, feature int, state int, value double")
    observed = spark.createDataFrame([(p, f"s{i + 1}", c - 1) for p in (0, 1) for i, c in enumerate(seen)], "photo int, var string, state int")
    graphs = factors.Graphs.pack(factors.regions_of(segs, near), features, 2, 9, observed=observed)
    w, path = factors.learn(graphs, np.ones(9), rounds=8, sweeps=50)
    assert path == sorted(path, reverse=True) and path[-1] < 0.8 * path[0]
    got = {(r["photo"], r["seg"]): r["class"] for r in factors.decode(factors.infer(graphs, w)).collect()}
    assert got == {(p, i + 1): c for p in (0, 1) for i, c in enumerate(seen)}


def test_distances_and_critical_paths_of_random_graphs(spark):
    rng = random.Random(11)
    edges = list({(a, b): (a, b, float(rng.randint(1, 9))) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(35)) if a != b}.values())
    far = {(a, b): 0.0 if a == b else math.inf for a in range(14) for b in range(14)}
    for a, b, w in edges:
        far[a, b] = min(far[a, b], w)
    for k, a, b in product(range(14), repeat=3):
        far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    got = {(r["src"], r["dst"]): r["w"] for r in graph.distances(spark.createDataFrame(edges, "src int, dst int, w double")).collect()}
    assert got == {k: v for k, v in far.items() if k[0] != k[1] and v < math.inf}

    works = [(a, b, w) for a, b, w in edges if a < b]
    start, rest = dict.fromkeys(range(14), 0.0), dict.fromkeys(range(14), 0.0)
    for a, b, w in sorted(works):
        start[b] = max(start[b], start[a] + w)
    for a, b, w in sorted(works, reverse=True):
        rest[a] = max(rest[a], rest[b] + w)
    whole = max(start.values())
    found = {(r["src"], r["dst"]): (r["start"], r["slack"]) for r in graph.critical_path(spark.createDataFrame(works, "src int, dst int, w double")).collect()}
    assert found == {(a, b): (start[a], whole - rest[b] - w - start[a]) for a, b, w in works}
    assert any(s == 0 for _, s in found.values())
