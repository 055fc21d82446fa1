import random

import pytest
from graphs import brute_cliques, cliques_of, edges_df
from pyspark.sql import functions as F

import tightknit as tk
from tightknit.operators import bitmaps, kclique
from tightknit.plans.dealing import deal
from tightknit.plans.ranked import rank_graph
from tightknit.plans.stable import stable


def dense_pairs(n, density, seed):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < density]


@pytest.fixture(scope="module")
def dense(spark):
    return tk.rank_graph(tk.stable(edges_df(spark, dense_pairs(150, 0.45, 1))))


def lists_of(graph):
    return graph.out.select(F.col("v").alias("w"), "nbrs")


def test_lists_of_dense_neighborhoods_are_eight_times_smaller(dense):
    bits = stable(bitmaps.local_bitmaps(dense, lists_of(dense)))
    ids = stable(kclique.wedge_closures(dense, lists_of(dense)))
    n_bits, n_ids = (d.agg(F.sum(F.size(c))).first()[0] for d, c in ((bits, "words"), (ids, "ext")))
    assert 8 * n_bits <= n_ids
    assert bits.agg(F.sum("n_ext")).first()[0] == n_ids


def test_places_are_those_of_the_ids(dense, monkeypatch):
    """Words beyond the first, blocks beyond the first, and lists cut into pieces."""
    monkeypatch.setattr(bitmaps, "BLOCK", 64)
    monkeypatch.setattr(kclique, "PIECE", 7)
    bits = bitmaps.with_ids(
        bitmaps.local_bitmaps(dense, lists_of(dense)).withColumn("clique", F.array("anchor", "w")), dense, 1 << 20
    )
    ids = kclique.wedge_closures(dense, lists_of(dense))
    assert {tuple(r.clique): r.ext for r in bits.collect()} == {(r.anchor, r.w): r.ext for r in ids.collect()}


@pytest.mark.parametrize("piece", [1 << 12, 2])
def test_cliques_of_many_words(spark, monkeypatch, piece):
    pairs = [(0, v) for v in range(1, 140)] + [(a + 1, b + 1) for a, b in dense_pairs(139, 0.15, 2)]
    monkeypatch.setattr(kclique, "PIECE", piece)
    graph = rank_graph(stable(edges_df(spark, pairs)), "id")
    found, _ = brute_cliques(pairs, 5)
    assert cliques_of(tk.kcliques(graph, 5, "bitmap")) == found[5]
    hist = tk.clique_histogram(graph, 5, "bitmap", max_broadcast_bytes=0)
    assert {r.clique_size: r.n_cliques for r in hist.collect()} == {k: len(c) for k, c in found.items()}


def test_work_is_dealt_evenly(spark):
    """Three hubs among many short lists: no task has more than twice the mean."""
    rows = stable(spark.range(4000).select("id", F.when(F.col("id") % 1500 == 0, 60_000).otherwise(F.col("id") % 97).alias("n")))
    dealt = deal(rows, ["id"], F.col("n"), 4).withColumn("p", F.spark_partition_id())
    per_task = {r.p: r.total for r in dealt.groupBy("p").agg(F.sum("n").alias("total")).collect()}
    assert len(per_task) == 4 and max(per_task.values()) <= 2 * sum(per_task.values()) / 4
    assert sorted(r.id for r in dealt.collect()) == list(range(4000))


def test_wedges_of_hubs_are_dealt_by_work(spark, monkeypatch):
    pairs = [(hub, v) for hub in range(3) for v in range(100, 900)] + [(v, v + 1) for v in range(100, 800)]
    graph = rank_graph(stable(edges_df(spark, pairs)), "id")
    monkeypatch.setattr(kclique, "PIECE", 16)
    made = kclique.wedges(graph, 0, num_partitions=6).withColumn("p", F.spark_partition_id())
    ids = F.sum(F.size("rest") + 1)
    per_task = [r.ids for r in made.groupBy("p").agg(ids.alias("ids")).collect()]
    assert len(per_task) == 6 and max(per_task) <= 2 * sum(per_task) / 6
    found, _ = brute_cliques(pairs, 3)
    for strategy in ("join", "bitmap"):
        assert tk.count_kcliques(graph, 3, strategy, num_partitions=6).first().n_cliques == len(found[3])
