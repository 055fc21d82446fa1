"""Plans at the shape of a large cluster run: no broadcast, hub vertices, bounded lists."""

import pytest
from graphs import brute_cliques, brute_maximal, cliques_of, edges_df
from pyspark.sql import functions as F

import tightknit as tk
from tightknit.operators import kclique, maximal
from tightknit.plans import stable as stable_module
from tightknit.plans.ranked import rank_graph

CORE = [(a, b) for a in range(6) for b in range(a + 1, 6)]
# Three hubs are an end of nearly all edges, each of over a quarter, and share their neighbors.
HUB = (
    CORE
    + [(hub, v) for hub in range(3) for v in range(100, 3100)]
    + [(v, v + 1) for v in range(100, 1500)]
)


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def hub(spark):
    return tk.stable(edges_df(spark, HUB).repartition(4))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_degree_order_bounds_every_list(hub):
    graph = rank_graph(hub)
    longest = graph.out.agg({"n_out": "max"}).first()[0]
    assert longest <= (2 * len(HUB)) ** 0.5
    assert {r.v: r.n_out for r in graph.out.filter("v < 3").collect()} == {0: 2, 1: 1}  # hub 2 ranks last


def test_id_order_is_exact_for_hubs(hub):
    """The first states are the neighbors of larger id, however many a vertex has."""
    nbrs = {}
    for a, b in HUB:
        nbrs.setdefault(min(a, b), set()).add(max(a, b))
    states = tk.init_frontier(rank_graph(hub, "id").out)
    assert {tuple(r.clique): r.ext for r in states.collect()} == {(v,): sorted(ws) for v, ws in nbrs.items()}


@pytest.mark.parametrize("strategy", ["join", "ego"])
def test_hub_counts_without_broadcast(hub, no_broadcast, strategy):
    found, _ = brute_cliques(HUB, 5)
    hist = tk.clique_histogram(hub, 5, strategy)
    assert {r.clique_size: r.n_cliques for r in hist.collect()} == {k: len(c) for k, c in found.items()}
    plan = final_plan(hist)
    assert "BroadcastHashJoin" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hub_key_is_split_by_the_adaptive_skew_join(hub, no_broadcast):
    """Every neighbor of the hubs looks a hub's list up: a quarter of all rows under one key."""
    found, _ = brute_cliques(HUB, 3)
    count = tk.count_kcliques(hub, 3, "join")
    assert "skew=true" in final_plan(count)
    assert count.first().n_cliques == len(found[3])


def test_rank_join_splits_hubs(hub, no_broadcast):
    """The joins that attach ranks to edges have a stored table on both sides."""
    degrees = tk.stable(tk.degrees(hub))
    ends = hub.join(degrees.withColumnRenamed("v", "src"), "src")
    assert "skew=true" in final_plan(ends)
    assert ends.count() == hub.count()


def test_hub_maximal_cliques_without_broadcast(hub, no_broadcast):
    found = tk.maximal_cliques(hub, max_broadcast_bytes=0)
    assert cliques_of(found) == brute_maximal(HUB)


@pytest.mark.parametrize("strategy", ["join", "ego", "broadcast"])
def test_long_lists_are_unfolded_in_pieces(hub, monkeypatch, strategy):
    monkeypatch.setattr(kclique, "PIECE", 3)
    found, _ = brute_cliques(HUB, 4)
    hist = tk.clique_histogram(hub, 4, strategy, order="id")
    assert {r.clique_size: r.n_cliques for r in hist.collect()} == {k: len(c) for k, c in found.items()}
    assert cliques_of(tk.kcliques(hub, 4, strategy)) == found[4]


def test_broadcast_needs_a_measured_size(hub):
    small = tk.count_kcliques(hub, 4, "broadcast")
    assert "BroadcastHashJoin" in final_plan(small)
    large = tk.count_kcliques(hub, 4, "broadcast", max_broadcast_bytes=1000)
    assert "SortMergeJoin" in final_plan(large) and "BroadcastHashJoin" not in final_plan(large)
    assert small.collect() == large.collect()


def test_unfolding_in_pieces_gives_the_same_states(hub, monkeypatch):
    lists = rank_graph(hub, "id").out
    whole = {tuple(r.clique): r.ext for r in tk.expand(tk.init_frontier(lists), lists).filter("size(ext) > 0").collect()}
    monkeypatch.setattr(kclique, "PIECE", 3)
    rows = kclique.unfold(tk.init_frontier(lists), "ext")
    assert "sequence" in rows._jdf.queryExecution().optimizedPlan().toString()
    cut = {tuple(r.clique): r.ext for r in tk.expand(tk.init_frontier(lists), lists).filter("size(ext) > 0").collect()}
    assert cut == whole
    assert cliques_of(tk.maximal_cliques(hub)) == brute_maximal(HUB)


@pytest.mark.parametrize("strategy", ["join", "ego", "broadcast"])
def test_histogram_intersects_each_level_once(hub, monkeypatch, strategy):
    """The last level is counted from a plan with one intersection; the others are stored tables."""
    seen = []
    stored = kclique.stable
    monkeypatch.setattr(kclique, "stable", lambda df: seen.append(intersections(df)) or stored(df))
    hist = tk.clique_histogram(hub, 6, strategy)
    assert seen == [1] * len(seen) and len(seen) in (3, 4)
    assert intersections(hist) + len(seen) == 4


def intersections(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect")


def test_small_anchors_are_left_out_before_the_triangles(hub):
    plan = kclique.wedges(rank_graph(hub), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_out,5)" in plan


def test_maximality_takes_one_join_for_each_member(hub, no_broadcast):
    found, _ = brute_cliques(HUB, 4)
    listed = tk.stable(tk.cliques_upto(hub, 4))
    maximal_ones = brute_maximal(HUB)
    kept = tk.is_maximal(listed, hub)
    assert kept.columns == listed.columns
    assert cliques_of(kept) == {c for cs in found.values() for c in cs} & maximal_ones
    assert final_plan(kept).count("SortMergeJoin") <= 4


def test_lookup_cuts_the_edges_before_building_lists(hub, no_broadcast, spark):
    some = spark.createDataFrame([(0,), (150,), (7777,)], "v bigint")
    _, nbrs = brute_cliques(HUB, 1)
    assert {r.v: r.nbrs for r in tk.neighbors(hub, some).collect()} == {v: sorted(nbrs[v]) for v in (0, 150)}


def test_last_level_is_not_built(hub):
    plan = tk.count_kcliques(hub, 4, "join")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 2  # sizes 2 and 3 only
    assert "clique#" not in plan  # members are not carried when counting


def test_scan_reads_two_columns(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = tk.edges_from_pairs(table, "l_partkey", "l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
    assert "IsNotNull(l_partkey)" in plan


def test_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    shared = str(tmp_path / "shared")
    conf = {"spark.checkpoint.dir": shared}

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: conf.get(key, default))

        class sparkContext:
            applicationId = "app-1"
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return conf

            @staticmethod
            def getCheckpointDir():
                return conf.get("set by the program")

    assert stable_module.table_folder(Session) == f"{shared}/tightknit-app-1"
    conf.clear()
    conf["set by the program"] = "hdfs:///own"
    assert stable_module.table_folder(Session) == "hdfs:///own/tightknit-app-1"
    conf.clear()
    with pytest.raises(ValueError):
        stable_module.table_folder(Session)


def test_tables_are_written_below_the_folder(spark):
    from pathlib import Path

    tk.stable(spark.range(3))
    folder = Path(stable_module.table_folder(spark).replace("file:", ""))
    assert folder.exists()
    table = tk.stable(spark.range(3))
    path = Path(table.inputFiles()[0].replace("file://", "")).parent
    assert path.exists()
    tk.drop_table(table)
    assert not path.exists() and folder.exists()
    with pytest.raises(ValueError):
        tk.drop_table(spark.read.parquet("/root/testdata/sf0.001/part.parquet"))


def test_rounds_of_the_maximal_search_shuffle_the_lists_once(hub, no_broadcast):
    """Pivot and branch lookups of a round read the same exchange."""
    graph = rank_graph(hub)
    local = tk.stable(maximal._neighborhoods(graph, 0).withColumn("n_pool", F.size("nbrs")))
    live = local.select(
        "anchor", F.array("m").alias("clique"), F.col("nbrs").alias("pool"),
        F.slice("nbrs", F.lit(1), F.col("n_low")).alias("done"),
    )
    lists = local.select("anchor", "m", "nbrs").hint("merge")
    plan = final_plan(maximal._branch(live, lists, True, 1, False))
    assert "ReusedExchange" in plan and plan.count("SortMergeJoin") >= 2
    few = final_plan(maximal._branch(live, local, True, 1, True))
    assert few.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in few


def test_jobs_share_one_ranked_graph(hub, monkeypatch):
    """Nothing is ranked again, and every job gives what it gives for the edges."""
    graph = rank_graph(hub)
    monkeypatch.setattr(kclique, "rank_graph", None)
    found, _ = brute_cliques(HUB, 4)
    for k in (1, 2, 3, 4):
        assert tk.count_kcliques(graph, k).first().n_cliques == len(found[k])
        assert cliques_of(tk.kcliques(graph, k)) == found[k]
    assert cliques_of(tk.cliques_upto(graph, 4)) == {c for cs in found.values() for c in cs}
    assert tk.triangle_count(graph).first()[0] == len(found[3])
    assert tk.cliques_per_anchor(graph, 3).agg({"n_cliques": "sum"}).first()[0] == len(found[3])
    assert tk.ego_network(graph, above=True).count() == len(found[3])
    assert cliques_of(tk.maximal_cliques(graph)) == brute_maximal(HUB)


def test_partition_counts_reach_the_joins_and_the_files(hub, no_broadcast, spark):
    count = tk.count_kcliques(hub, 4, "join", num_partitions=7)
    assert final_plan(count).count(", 7), REPARTITION_BY_NUM") == 2
    found, _ = brute_cliques(HUB, 4)
    assert count.first().n_cliques == len(found[4])
    assert cliques_of(tk.maximal_cliques(hub, num_partitions=3)) == brute_maximal(HUB)
    path = tk.write_cliques(tk.kcliques(hub, 4), f"{stable_module.table_folder(spark)}/in-three", num_partitions=3)
    assert len(spark.read.text(path).inputFiles()) == 3
    assert cliques_of(tk.read_cliques(spark, path)) == found[4]
