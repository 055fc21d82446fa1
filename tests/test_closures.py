"""Lists that travel: only those asked for, the shorter one of two, and none for what needs none."""

import pytest
from graphs import brute_cliques, brute_maximal, cliques_of, edges_df, random_pairs
from pyspark.sql import functions as F

import tightknit as tk
from tightknit.functions.arrays import empty_list, ordered_intersect
from tightknit.operators import closures, kclique, maximal
from tightknit.plans.ranked import ORDERS

# Two hubs with the same 300 neighbors, of which every tenth is adjacent to the next; then small dense graphs.
PAIRS = [(0, 1)] + [(h, v) for h in (0, 1) for v in range(100, 400)] + [(v, v + 1) for v in range(100, 390, 10)]
PAIRS = sorted(set(PAIRS) | set(random_pairs(seed=3, graphs=5, n=8)))


@pytest.fixture(scope="module")
def graph(spark):
    return tk.stable(edges_df(spark, PAIRS))


def ids_in(df):
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<bigint>"]
    return df.agg(sum((F.sum(F.coalesce(F.size(c), F.lit(0))) for c in arrays), F.lit(0))).first()[0] or 0


def test_lists_in_no_other_list_are_not_fetched(graph):
    """By degree nearly all vertices stand before their neighbors; a limit that takes the hubs' lists takes all that is asked for."""
    ranked = tk.rank_graph(graph)
    assert ranked.asked_bytes < ranked.n_bytes / 2
    inside = {r.w for r in ranked.out.select(F.explode("nbrs").alias("w")).collect()}
    assert {r.w for r in ranked.asked.collect()} == {r.v for r in ranked.out.collect()} & inside
    plan = tk.count_kcliques(ranked, 3, max_broadcast_bytes=ranked.asked_bytes)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("order", ORDERS)
def test_shorter_lists_close_the_same_triangles(graph, order, limit):
    ranked = tk.rank_graph(graph, order, seed=4)
    for how in ("inner", "left"):
        plain = kclique.wedge_closures(ranked, ranked.asked.select("w", "nbrs"), how)
        short = kclique.wedge_closures(ranked, None, how, limit=limit)
        assert sorted(map(tuple, short.collect())) == sorted(map(tuple, plain.collect()))


def test_the_shorter_list_travels(graph):
    """In id order both hubs have 300 candidates, and nearly none of these has a list."""
    ranked = tk.rank_graph(graph, "id")
    rows = kclique._places(ranked, 1, 0, None)
    met = closures.met_wedges(ranked, rows).select("anchor", "w", "rest", "nbrs")
    sent = met.select(F.sum(F.least(F.size("rest"), F.size("nbrs")))).first()[0]
    assert sent * 50 < ids_in(kclique.wedges(ranked, 1))
    assert met.filter(F.size(ordered_intersect("rest", F.coalesce("nbrs", empty_list()))) > 0).count() > 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_children_without_a_list_are_not_shuffled(graph, limit):
    ranked = tk.rank_graph(graph, "id")
    found = tk.expand(tk.init_frontier(ranked.out), ranked.out, ranked.longest, limit)
    nbrs = brute_cliques(PAIRS, 1)[1]
    want = sorted((a, b, sorted(x for x in nbrs[a] & nbrs[b] if x > b)) for a, b in PAIRS)
    assert sorted((*r.clique, r.ext) for r in found.collect()) == want
    assert ("LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_maximality_of_edges_takes_no_lists_along(graph, monkeypatch, limit):
    """The lists of the hubs would come to 300 ids for each of their 600 edges."""
    stored = []
    for name in ("stable", "stable_measured"):
        make = getattr(maximal, name)
        monkeypatch.setattr(maximal, name, lambda *a, make=make, **m: stored.append(make(*a, **m)) or stored[-1])
    listed = tk.stable(tk.cliques_upto(graph, 3))
    kept = tk.is_maximal(listed, graph, max_broadcast_bytes=limit)
    found, _ = brute_cliques(PAIRS, 3)
    assert cliques_of(kept) == {c for cs in found.values() for c in cs} & brute_maximal(PAIRS)
    tables = [t[0] if isinstance(t, tuple) else t for t in stored]
    assert max(map(ids_in, tables)) < 20 * len(PAIRS)


def test_lists_are_built_for_members_only(graph, spark, monkeypatch):
    lists = []
    make = maximal.fetch_side
    monkeypatch.setattr(maximal, "fetch_side", lambda t, *a: lists.append(t) or make(t, *a))
    some = spark.createDataFrame([([100, 101],), ([0, 1, 100, 101],), ([0, 1, 105],)], "clique array<bigint>")
    assert cliques_of(tk.is_maximal(some, graph)) == {(0, 1, 100, 101), (0, 1, 105)}
    assert {r.v for t in lists if "nbrs" in t.columns for r in t.collect()} == {0, 1, 100, 101, 105}
