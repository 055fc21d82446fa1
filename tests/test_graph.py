import pytest
from graphs import FIXTURES, brute_cliques, edges_df, random_pairs

import tightknit as tk
from tightknit.functions.text import format_info
from tightknit.plans import stable as stable_module


@pytest.mark.parametrize("name", FIXTURES)
def test_graph_info(spark, name):
    pairs, (n_vertices, n_edges), _, _ = FIXTURES[name]
    row = tk.graph_info(edges_df(spark, pairs)).first()
    assert tuple(row) == (n_vertices, n_edges, n_edges / n_vertices, 2 * n_edges / n_vertices)


def test_graph_info_with_extra_vertices_and_empty(spark):
    edges = edges_df(spark, [(1, 2)])
    extra = spark.createDataFrame([(2,), (7,), (7,)], "v bigint")
    assert tuple(tk.graph_info(edges, extra).first()) == (3, 1, 1 / 3, 2 / 3)
    assert tuple(format_info(tk.graph_info(edges, extra)).first()) == ("3", "1", "0.33", "0.67")
    assert tuple(tk.graph_info(edges.filter("src > 5")).first()) == (0, 0, None, None)


@pytest.mark.parametrize("bound", [1 << 17, 3])
def test_adjacency_matches_sets(spark, bound):
    pairs = random_pairs(graphs=4)
    _, nbrs = brute_cliques(pairs, 1)
    edges = edges_df(spark, pairs)
    wanted = {
        "both": nbrs,
        "out": {v: {w for w in ws if w > v} for v, ws in nbrs.items()},
        "in": {v: {w for w in ws if w < v} for v, ws in nbrs.items()},
    }
    for direction, lists in wanted.items():
        adj = tk.adjacency(edges, direction, tk.vertices_of(edges), list_bound=bound)
        rows = adj.collect()
        assert len({(r.v, r.part) for r in rows}) == len(rows)
        got = {}
        for r in rows:
            assert r.nbrs == sorted(r.nbrs) and r.degree == len(lists[r.v])
            assert len(r.nbrs) <= bound
            got.setdefault(r.v, {})[r.part] = r.nbrs
        # The parts in order are the ascending list, each but the last one full.
        assert {v: sum((parts[p] for p in range(len(parts))), []) for v, parts in got.items()} == {
            v: sorted(ws) for v, ws in lists.items()}
        assert all(len(parts[p]) == bound for parts in got.values() for p in range(len(parts) - 1))
        if bound > 100:
            assert all(r.part == 0 for r in rows)


def test_list_integrity(spark):
    adj = tk.adjacency(edges_df(spark, [(1, 2), (2, 3)]))
    assert tuple(tk.list_integrity(adj).first()) == (3, 3, 3, 0)
    assert tuple(tk.list_integrity(adj.union(adj)).first()) == (6, 3, 3, 3)
    parts = tk.adjacency(edges_df(spark, [(1, v) for v in range(2, 12)]), list_bound=4)
    assert tuple(tk.list_integrity(parts).first()) == (13, 13, 11, 0)
    assert tuple(tk.list_integrity(adj.limit(0)).first()) == (0, 0, 0, 0)


def test_parts_over_range_partitions(spark):
    """A hub's list is numbered across many partitions, and comes back whole from text."""
    pairs = [(0, v) for v in range(1, 400)] + [(1, v) for v in range(2, 300)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        adj = tk.stable(tk.adjacency(edges_df(spark, pairs).repartition(7), list_bound=8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    _, nbrs = brute_cliques(pairs, 1)
    rows = sorted(adj.collect(), key=lambda r: (r.v, r.part))
    for v in (0, 1, 5, 399):
        assert sum((r.nbrs for r in rows if r.v == v), []) == sorted(nbrs[v])
    path = tk.write_neighbor_list(adj, f"{stable_module.table_folder(spark)}/parts-in-text")
    back = {r.v: r.nbrs for r in tk.read_adjacency(spark, path, merge=True).collect()}
    assert back == {v: sorted(ws) for v, ws in nbrs.items()}


def test_neighbors_and_degree_prune(spark):
    edges = edges_df(spark, [(1, 2), (1, 3), (1, 4), (2, 3)])
    adj = tk.adjacency(edges, "out")
    some = spark.createDataFrame([(2,), (9,)], "v bigint")
    assert [(r.v, r.nbrs) for r in tk.neighbors(edges, some, "out").collect()] == [(2, [3])]
    assert [(r.v, r.part, r.degree, r.nbrs) for r in tk.neighbors(edges, some, list_bound=1).orderBy("part").collect()] == [
        (2, 0, 2, [1]), (2, 1, 2, [3])]
    assert [r.v for r in tk.prune_vertices(adj, 3).collect()] == [1]


def test_symmetrize_orient_degrees(spark):
    edges = edges_df(spark, [(1, 2), (2, 3)])
    both = tk.symmetrize(edges)
    assert sorted(map(tuple, both.collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert sorted(map(tuple, tk.orient(both).collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, tk.degrees(edges).collect())) == [(1, 1), (2, 2), (3, 1)]


def test_ego_network(spark):
    pairs = random_pairs(graphs=3)
    _, nbrs = brute_cliques(pairs, 1)
    edges = edges_df(spark, pairs)
    want = {(v, a, b) for v, ws in nbrs.items() for a, b in pairs if a in ws and b in ws}
    assert {tuple(r) for r in tk.ego_network(edges).collect()} == want
    assert {tuple(r) for r in tk.ego_network(edges, above=True).collect()} == {
        t for t in want if t[0] < t[1]}


def test_bad_direction(spark):
    with pytest.raises(ValueError):
        tk.adjacency(edges_df(spark, [(1, 2)]), "sideways")
