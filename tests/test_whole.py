"""Queries that have to read all of their tables."""

from collections import Counter

from regiolith.operators import small_graphs as s
from regiolith.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_grid_reads_orders_of_any_key(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (7000, 4), (7001, 5), (7061, 6)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert {tuple(r) for r in catalog.QUERIES["grid_adjacency"](spark, str(tmp_path)).collect()} == {(0, 1), (4, 5), (5, 6)}


def test_small_graphs_have_all_lines_of_an_order(spark):
    lines = Counter(r[0] for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey").collect())
    assert max(lines.values()) > 8
    got = {(r["photo"], r["problem"]): r["value"] for r in catalog.QUERIES["small_graph_problems"](spark, FOLDER).collect()}
    for photo, n in lines.items():
        if n >= 5:  # a ring with the chord 1-3
            assert got[photo, "tour"] == n and got[photo, "edge_cover"] == (n + 1) // 2
            assert got[photo, "stable"] + got[photo, "vertex_cover"] == n and got[photo, "cycles"] == 2 and got[photo, "cocycles"] == n - 1


def test_large_rings_are_solved():
    n = 24
    edges = [(i, i % n + 1, 1.0) for i in range(1, n + 1)]
    assert len(s.absorbing_nodes(edges)) == len(s.absorbing_edges(edges)) == n // 3
    assert s.shortest_tour({e[:2]: e[2] for e in edges})[:2] in ([1, 2], [1, n])
    assert s.shortest_tour({(1, 2): 1.0, (2, 3): 1.0}) == []
