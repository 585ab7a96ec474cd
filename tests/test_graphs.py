import random

import pytest

from regiolith.operators import graph, small_graphs as s


def pairs_of(df):
    return {tuple(r) for r in df.collect()}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}


def test_forest_weighs_what_kruskal_weighs(spark):
    rng = random.Random(2)
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), float(rng.randint(1, 9))) for a, b in [(rng.randrange(20), rng.randrange(20)) for _ in range(60)] if a != b}.values())
    got = graph.spanning_forest(spark.createDataFrame(edges, "src long, dst long, w double")).collect()
    want = [edges[i] for i in s.spanning_tree(edges)]
    assert len(got) == len(want) and sum(r["w"] for r in got) == sum(e[2] for e in want)


def test_paths_closure_and_strong_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0), (3, 4, 2.0)], "src int, dst int, w double")
    assert (1, 3, 2.0) in pairs_of(graph.distances(e)) and (1, 4, 4.0) in pairs_of(graph.distances(e))
    assert len(pairs_of(graph.closure(e))) == 12
    assert dict(pairs_of(graph.strong_components(e))) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["node"] for r in graph.bases(e).collect()} == {1, 2, 3}
    assert {r["node"] for r in graph.bases(e, contra=True).collect()} == {4}


def test_critical_path(spark):
    works = spark.createDataFrame([(1, 2, 3.0), (2, 4, 4.0), (1, 3, 2.0), (3, 4, 1.0)], "src int, dst int, w double")
    got = {(r["src"], r["dst"]): (r["start"], r["slack"]) for r in graph.critical_path(works).collect()}
    assert got == {(1, 2): (0.0, 0.0), (2, 4): (3.0, 0.0), (1, 3): (0.0, 4.0), (3, 4): (2.0, 4.0)}
    with pytest.raises(ValueError):
        graph.critical_path(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src int, dst int, w double"))


def test_euler_and_trees(spark):
    edges = [("ring", 1, 2), ("ring", 2, 3), ("ring", 3, 1), ("path", 1, 2), ("path", 2, 3), ("star", 0, 1), ("star", 0, 2), ("star", 0, 3)]
    got = {r["name"]: r["euler"] for r in graph.euler(spark.createDataFrame(edges, "name string, src int, dst int"), ["name"]).collect()}
    assert got == {"ring": 1.0, "path": 0.5, "star": 0.0}
    assert [r["tree"] for r in graph.trees(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).collect()] == [True]


RING = [(i, i % 6 + 1, float(i)) for i in range(1, 7)]


def test_small_problems():
    value, flow, side = s.max_flow([(1, 2, 3.0), (1, 3, 2.0), (2, 4, 2.0), (3, 4, 3.0), (2, 3, 1.0)], 1, 4)
    assert value == 5.0 and 1 in side and sum(flow[i] for i in (0, 1)) == 5.0
    assert sum(RING[i][2] for i in s.max_matching(RING)) == 12.0
    assert len(s.max_stable_set(RING)) == 3 and len(s.max_clique(RING)) == 2 and len(s.vertex_cover(RING)) == 3
    assert len(s.edge_cover(RING)) == 3 and len(s.absorbing_nodes(RING)) == 2 and len(s.absorbing_edges(RING)) == 2
    assert max(s.colour_nodes(RING).values()) == 2 and max(s.colour_nodes([*RING, (1, 3, 1.0)]).values()) == 3
    colours = s.colour_edges(RING)
    assert all(colours[i] != colours[(i + 1) % 6] for i in range(6))
    assert sorted(s.euler_walk(RING)) == list(range(6)) and s.euler_walk([(0, 1, 1), (0, 2, 1), (0, 3, 1)]) == []
    assert [sorted(c) for c in s.cycle_basis(RING)] == [list(range(6))] and len(s.cocycle_basis(RING)) == 5
    assert s.isomorphism(RING, [(a + 10, b + 10, 1) for a, b, _ in RING]) and s.isomorphism(RING, RING[:5]) is None
    assert s.shortest_tour({(1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 1): 1, (1, 3): 9, (2, 4): 9}) in ([1, 2, 3, 4], [1, 4, 3, 2])
    assert s.vertex_path([(1, 2), (2, 4), (1, 3), (3, 4)], {1: 1, 2: 5, 3: 2, 4: 1}, 1, 4) == (4, [1, 3, 4])
    two = s.two_hop_colours({1: {2}, 2: {1, 3}, 3: {2}})
    assert len(set(two.values())) == 3


def test_segments_and_hierarchy():
    got = s.segments(6, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 50.0), (3, 4, 1.0), (4, 5, 1.0)], 5.0)
    assert len({*got[:3]}) == 1 and len({*got[3:]}) == 1 and got[0] != got[5]
    merged = s.merge_hierarchy([1.0, 1.0, 5.0], {(0, 1): 0.9, (1, 2): 0.5}, lambda a, b, whole: 1 - (a + b) / whole)
    assert [(m[0], m[1], m[2]) for m in merged] == [(3, 0, 1), (4, 2, 3)]
