import pytest
from graphs import FIXTURES, brute_cliques, cliques_of, edges_df, random_pairs

import tightknit as tk
from tightknit.operators.kclique import STRATEGIES
from tightknit.plans.ranked import ORDERS

PAIRS = random_pairs()
FOUND, NBRS = brute_cliques(PAIRS, 7)


@pytest.fixture(scope="module")
def graph(spark):
    return tk.stable(edges_df(spark, PAIRS))


@pytest.mark.parametrize("name", FIXTURES)
def test_closed_forms(spark, name):
    pairs, (n_vertices, n_edges), (k3, k4, k5), _ = FIXTURES[name]
    rows = tk.clique_histogram(edges_df(spark, pairs), 6).collect()
    assert {r.clique_size: r.n_cliques for r in rows} == {
        1: n_vertices, 2: n_edges, 3: k3, 4: k4, 5: k5, 6: 0}


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("order", ORDERS)
def test_counts_agree_for_all_strategies_and_orders(graph, strategy, order):
    for k in (3, 5):
        row = tk.count_kcliques(graph, k, strategy, order, seed=3, num_partitions=3).first()
        assert tuple(row) == (k, len(FOUND[k]))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_histogram(graph, strategy):
    rows = tk.clique_histogram(graph, 7, strategy).collect()
    assert {r.clique_size: r.n_cliques for r in rows} == {k: len(c) for k, c in FOUND.items()}


def test_small_k(graph):
    assert tk.count_kcliques(graph, 1).first().n_cliques == len(NBRS)
    assert tk.count_kcliques(graph, 2).first().n_cliques == len(PAIRS)
    assert tk.triangle_count(graph).first().n_triangles == len(FOUND[3])
    for k in (0, -1):
        with pytest.raises(ValueError):
            tk.count_kcliques(graph, k)
    with pytest.raises(ValueError):
        tk.count_kcliques(graph, 3, "sorted")
    with pytest.raises(ValueError):
        tk.count_kcliques(graph, 3, order="size")


def test_isolated_vertices_count_at_size_one(spark, graph):
    extra = spark.createDataFrame([(PAIRS[0][0],), (42,), (42,)], "v bigint")
    assert tk.count_kcliques(graph, 1, vertices=extra).first().n_cliques == len(NBRS) + 1
    assert tk.clique_histogram(graph, 1, vertices=extra).first().n_cliques == len(NBRS) + 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_listing(graph, strategy):
    for k in (1, 2, 3, 4, 6):
        rows = tk.kcliques(graph, k, strategy)
        assert cliques_of(rows) == FOUND[k]
        assert all(r.clique == sorted(r.clique) and r.anchor == r.clique[0] and r.clique_size == k
                   for r in rows.collect())


def test_cliques_upto(graph):
    assert cliques_of(tk.cliques_upto(graph, 5)) == set().union(*(FOUND[k] for k in range(1, 6)))
    assert cliques_of(tk.cliques_upto(graph, 2, strategy="ego")) == FOUND[1] | FOUND[2]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_per_anchor(graph, k):
    for anchor, pick in (("min", min), ("max", max)):
        want = {}
        for c in FOUND[k]:
            want[pick(c)] = want.get(pick(c), 0) + 1
        rows = tk.cliques_per_anchor(graph, k, anchor).collect()
        assert {r.anchor: r.n_cliques for r in rows} == want


def test_per_anchor_rejects_other_anchors(graph):
    with pytest.raises(ValueError):
        tk.cliques_per_anchor(graph, 4, "middle")


def test_states(graph):
    lists = tk.rank_graph(graph, "id").out
    first = tk.init_frontier(lists, tk.vertices_of(graph))
    assert first.count() == len(NBRS)
    second = tk.expand(first, lists)
    assert {tuple(r.clique) for r in second.collect()} == FOUND[2]
    assert sum(len(r.ext) for r in second.collect()) == len(FOUND[3])
    kept = tk.bound_prune(second, 5).collect()
    assert kept and all(len(r.clique) + len(r.ext) >= 5 for r in kept)


def test_states_need_whole_lists(graph):
    parts = tk.adjacency(graph, "out", list_bound=2)
    with pytest.raises(ValueError):
        tk.init_frontier(parts)
    with pytest.raises(ValueError):
        tk.expand(tk.init_frontier(tk.rank_graph(graph).out), parts)


def test_state_and_report_text(spark):
    edges = edges_df(spark, [(1, 2), (1, 3), (2, 3)])
    first = tk.init_frontier(tk.rank_graph(edges, "id").out, tk.vertices_of(edges))
    states = first.select(tk.format_state().alias("s")).collect()
    assert sorted(r.s for r in states) == ["[1]->[2, 3]", "[2]->[3]", "[3]->[]"]
    hist = spark.createDataFrame([(3, 1234567), (4, 0)], "clique_size int, n_cliques bigint")
    assert [r.line for r in tk.format_report(hist).collect()] == [
        "Cliques of size 3 => 1,234,567", "Cliques of size 4 => 0"]


def test_adding_an_edge_never_lowers_a_count(spark):
    pairs = FIXTURES["k333"][0]
    before = tk.clique_histogram(edges_df(spark, pairs), 4).collect()
    after = tk.clique_histogram(edges_df(spark, pairs + [(0, 1)]), 4).collect()
    assert all(b.n_cliques <= a.n_cliques for b, a in zip(before, after))
    assert after[3].n_cliques == 9


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_compact_listing_stands_for_all_cliques(graph, spark, tmp_path, k):
    listing = tk.kcliques(graph, k, compact=True)
    assert listing.columns == ["prefix", "ext"]
    assert cliques_of(tk.expand_compact(listing)) == FOUND[k]
    assert [tuple(r) for r in tk.count_compact(listing).collect()] == [(k, len(FOUND[k]))]
    path = tk.write_cliques(listing, str(tmp_path / "compact"))
    assert cliques_of(tk.read_cliques(spark, path)) == FOUND[k]
