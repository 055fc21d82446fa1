import pytest
from graphs import FIXTURES, MESSY, brute_cliques, brute_maximal, cliques_of, edges_df, random_pairs

import tightknit as tk
from tightknit.operators.maximal import pivot_rule, search_rounds
from tightknit.plans.ranked import ORDERS

PAIRS = random_pairs(seed=5)
MAXIMAL = brute_maximal(PAIRS)


@pytest.fixture(scope="module")
def graph(spark):
    return tk.stable(edges_df(spark, PAIRS))


@pytest.mark.parametrize("name", FIXTURES)
def test_closed_forms(spark, name):
    pairs, _, _, sizes = FIXTURES[name]
    rows = tk.maximal_histogram(edges_df(spark, pairs)).collect()
    assert {r.clique_size: r.n_cliques for r in rows} == sizes


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("pivot", [True, False])
def test_random_graphs(graph, order, pivot):
    found = tk.maximal_cliques(graph, pivot, order, seed=2)
    assert cliques_of(found) == MAXIMAL
    assert all(r.clique == sorted(r.clique) and r.anchor == r.clique[-1] for r in found.collect())


@pytest.mark.parametrize("limit", [0, 4000, 40_000])
def test_without_broadcast_lists(graph, limit):
    """No broadcast at all; states of the last rounds only; states of most rounds."""
    assert cliques_of(tk.maximal_cliques(graph, max_broadcast_bytes=limit)) == MAXIMAL


def test_moon_moser_growth(spark):
    """Three vertices per group: 3^(n/3) maximal cliques."""
    from graphs import multipartite

    edges = edges_df(spark, multipartite(*([3 * i, 3 * i + 1, 3 * i + 2] for i in range(5))))
    assert [tuple(r) for r in tk.maximal_histogram(edges).collect()] == [(5, 243)]


def test_exact_size(graph, spark):
    for k in range(1, 8):
        want = sum(len(c) == k for c in MAXIMAL)
        assert tuple(tk.count_maximal_k(graph, k).first()) == (k, want)
    # A vertex between two members also disproves maximality.
    assert tk.count_maximal_k(edges_df(spark, FIXTURES["triangle"][0]), 2).first().n_cliques == 0
    with pytest.raises(ValueError):
        tk.count_maximal_k(graph, 0)


def test_isolated_vertex_is_a_maximal_clique(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text(MESSY)
    found = tk.read_edge_list(spark, str(path))
    rows = tk.maximal_histogram(found.edges, vertices=found.vertices).collect()
    assert {r.clique_size: r.n_cliques for r in rows} == {1: 1, 2: 2, 3: 1}


def test_empty_graph(spark):
    edges = edges_df(spark, [(1, 2)]).filter("src > 5")
    assert tk.maximal_cliques(edges).collect() == []
    assert tk.count_kcliques(edges, 4).first().n_cliques == 0


def test_is_maximal(graph, spark):
    for k in (2, 3, 4):
        kept = tk.is_maximal(tk.kcliques(graph, k), graph)
        assert cliques_of(kept) == {c for c in MAXIMAL if len(c) == k}
    assert cliques_of(tk.is_maximal(tk.cliques_upto(graph, 4), graph)) == {c for c in MAXIMAL if len(c) <= 4}
    whole = tk.maximal_cliques(graph)
    assert cliques_of(tk.is_maximal(whole, graph)) == MAXIMAL
    lone = spark.createDataFrame([([77],), ([PAIRS[0][0]],)], "clique array<bigint>")
    assert cliques_of(tk.is_maximal(lone, graph)) == {(77,)}


def test_every_kclique_lies_in_a_maximal_clique(graph):
    for c in cliques_of(tk.kcliques(graph, 4)):
        assert any(set(c) <= set(m) for m in MAXIMAL)


def test_pivot_of_most_neighbors_leaves_fewer_states(spark):
    pairs = random_pairs(seed=8, graphs=3, n=12)
    graph = tk.rank_graph(tk.stable(edges_df(spark, pairs)), "id")
    n_states = {p: sum(t.count() for t in search_rounds(graph, p)) for p in ("last", "max")}
    assert n_states["max"] < n_states["last"]
    assert cliques_of(tk.maximal_cliques(graph, "max")) == brute_maximal(pairs)


def test_pivot_rules():
    assert [pivot_rule(True, o) for o in ("degree", "core", "id", "random")] == ["last", "last", "max", "max"]
    assert pivot_rule(False, "id") == "none"
    with pytest.raises(ValueError):
        pivot_rule("first", "id")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_is_maximal_with_hubs(spark, limit):
    """Hubs among the members, hubs as the only extending vertices, cliques of hubs alone."""
    pairs = sorted(set(PAIRS) | {(hub, v) for hub in range(-4, 0) for v in range(1000, 1040) if (hub + v) % 3} | {(-4, -3), (-4, -2), (-3, -2), (-2, -1)})
    edges = tk.stable(edges_df(spark, pairs))
    want = brute_maximal(pairs)
    found, _ = brute_cliques(pairs, 3)
    listed = tk.stable(tk.cliques_upto(edges, 3))
    kept = tk.is_maximal(listed, edges, hub_degree=9, max_broadcast_bytes=limit)
    assert cliques_of(kept) == {c for cs in found.values() for c in cs} & want
