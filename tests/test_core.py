import pytest
from graphs import brute_cliques, brute_maximal, cliques_of, complete, edges_df, random_pairs

import tightknit as tk
from tightknit.plans.ranked import rank_graph

# Two dense parts with tails, whose vertices leave one round after the other, and a ring.
RING = [(20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (20, 25)]
TAILS = [(7, 8), (8, 9), (9, 10), (10, 11), (3, 8)]
PAIRS = sorted({*complete(range(1, 8)), *TAILS, *RING, *random_pairs(seed=3, graphs=3)})


def brute_core(pairs, k):
    while True:
        _, nbrs = brute_cliques(pairs, 1)
        left = [p for p in pairs if all(len(nbrs[v]) >= k - 1 for v in p)]
        if len(left) == len(pairs):
            return set(pairs)
        pairs = left


def degeneracy(pairs):
    k = 1
    while brute_core(pairs, k + 1):
        k += 1
    return k - 1


@pytest.fixture(scope="module")
def graph(spark):
    return tk.stable(edges_df(spark, PAIRS))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 20])
def test_core_is_the_fixpoint(graph, k):
    want = brute_core(PAIRS, k) if k > 2 else set(PAIRS)
    assert {tuple(r) for r in tk.prune_core(graph, k).collect()} == want


def test_early_end_keeps_every_clique(graph):
    some = {tuple(r) for r in tk.prune_core(graph, 4, least_share=0.5).collect()}
    assert brute_core(PAIRS, 4) < some < set(PAIRS)


def test_peeling_changes_no_result(graph):
    found, _ = brute_cliques(PAIRS, 5)
    assert tk.count_kcliques(graph, 5, peel=True).first().n_cliques == len(found[5])
    assert cliques_of(tk.kcliques(graph, 4, peel=True)) == found[4]
    per_anchor = tk.cliques_per_anchor(graph, 4, peel=True).agg({"n_cliques": "sum"}).first()[0]
    assert per_anchor == len(found[4])
    want = sum(len(c) == 4 for c in brute_maximal(PAIRS))
    assert tk.count_maximal_k(graph, 4, peel=True).first().n_cliques == want


def test_core_order_bounds_lists_by_the_degeneracy(graph, spark):
    assert rank_graph(graph, "core").longest <= 2.5 * degeneracy(PAIRS)
    # A star has degeneracy 1, and a list of 1 where ranks by id have one of 300.
    star = tk.stable(edges_df(spark, [(0, i) for i in range(1, 301)]))
    assert (rank_graph(star, "core").longest, rank_graph(star, "id").longest) == (1, 300)


def test_rounds_cover_every_vertex_once(graph):
    rounds = [tuple(r) for r in tk.removal_rounds(graph).collect()]
    assert sorted(v for v, _ in rounds) == sorted({v for p in PAIRS for v in p})
    place = dict(rounds)
    _, nbrs = brute_cliques(PAIRS, 1)
    assert all(sum(place[w] >= place[v] for w in ws) <= 2.5 * degeneracy(PAIRS) for v, ws in nbrs.items())


def test_no_edges(graph):
    none = graph.filter("src > dst")
    assert tk.prune_core(none, 4).collect() == [] and tk.removal_rounds(none).collect() == []
    assert tk.count_kcliques(none, 4, order="core", peel=True).first().n_cliques == 0
    with pytest.raises(ValueError):
        tk.prune_core(none, 0)
