import gzip
from pathlib import Path

import pytest
from graphs import MESSY, edges_df
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tightknit as tk
from tightknit.sources.edge_list import edge_list_rows


def pairs_of(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_messy_edge_list(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text(MESSY)
    found = tk.read_edge_list(spark, str(path))
    assert pairs_of(found.edges) == [(-4, 10), (1, 2), (1, 3), (2, 3), (3, 10)]
    assert sorted(r.v for r in found.vertices.collect()) == [-4, 1, 2, 3, 8, 10]
    assert sorted((r.line, r.reason) for r in found.rejects.collect()) == [
        ("7", "too few tokens"), ("abc 5", "not numeric")]


def test_failfast_raises_on_non_numeric(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text(MESSY)
    found = tk.read_edge_list(spark, str(path), "FAILFAST")
    with pytest.raises(PySparkException):
        found.edges.collect()
    with pytest.raises(PySparkException):
        found.edges.count()
    with pytest.raises(PySparkException):
        found.vertices.count()


def test_failfast_skips_short_lines(spark, tmp_path):
    path = tmp_path / "short.txt"
    path.write_text("7\n1 2\n\n# 3 x\n")
    assert pairs_of(tk.read_edge_list(spark, str(path), "FAILFAST").edges) == [(1, 2)]


def test_ids_above_32_bits_and_compressed_input(spark, tmp_path):
    path = tmp_path / "big.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write("3000000000 1\n9223372036854775807 3000000000\n9223372036854775808 1\n")
    found = tk.read_edge_list(spark, str(path))
    assert pairs_of(found.edges) == [(1, 3000000000), (3000000000, 9223372036854775807)]
    assert [r.reason for r in found.rejects.collect()] == ["not numeric"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        tk.parse_edge_lines(spark.createDataFrame([("1 2",)], "value string"), "DROPMALFORMED")


def test_edges_from_pairs_drops_loops_repeats_nulls(spark):
    table = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 4), (5, 4)], "a int, b int")
    assert pairs_of(tk.edges_from_pairs(table, "a", "b")) == [(1, 2), (4, 5)]


def test_neighbor_list_round_trip(spark, tmp_path):
    edges = edges_df(spark, [(1, 2), (1, 3), (2, 3), (3, 10), (-4, 10)])
    vertices = spark.createDataFrame([(8,)], "v bigint")
    adj = tk.adjacency(edges, "both", vertices)
    path = tk.write_neighbor_list(adj, str(tmp_path / "adj"), num_partitions=2)
    lines = sorted(x for p in Path(path).glob("part-*") for x in p.read_text().splitlines())
    assert lines == sorted(["1 2 3", "2 1 3", "3 1 2 10", "10 -4 3", "-4 10", "8"])
    back = tk.read_adjacency(spark, path)
    assert {r.v: r.nbrs for r in back.collect()} == {
        1: [2, 3], 2: [1, 3], 3: [1, 2, 10], 10: [-4, 3], -4: [10], 8: []}
    assert pairs_of(tk.edges_from_adjacency(back)) == pairs_of(edges)


def test_adjacency_comments_and_blanks(spark, tmp_path):
    path = tmp_path / "adj.txt"
    path.write_text("# a b\n\n1 2 3\n  2\t1\n3 1\n9\n")
    adj = tk.read_adjacency(spark, str(path))
    assert sorted((r.v, r.nbrs) for r in adj.collect()) == [(1, [2, 3]), (2, [1]), (3, [1]), (9, [])]
    assert pairs_of(tk.edges_from_adjacency(adj)) == [(1, 2), (1, 3)]
    assert pairs_of(tk.edges_from_adjacency(adj.filter("v > 1"))) == [(1, 2), (1, 3)]
    path.write_text("1 2 x\n")
    with pytest.raises(PySparkException):
        tk.read_adjacency(spark, str(path)).collect()


def test_lists_in_parts_read_back_as_the_same_edges(spark, tmp_path):
    edges = edges_df(spark, [(0, i) for i in range(1, 40)])
    adj = tk.adjacency(edges, "both", list_bound=8)
    assert adj.filter("v = 0").count() > 1
    path = tk.write_neighbor_list(adj, str(tmp_path / "adj"), compression="gzip")
    assert all(p.suffix == ".gz" for p in Path(path).glob("part-*"))
    assert pairs_of(tk.edges_from_adjacency(tk.read_adjacency(spark, path))) == pairs_of(edges)


@pytest.mark.parametrize("sep", [",", "\t", "|"])
def test_clique_text_round_trip(spark, tmp_path, sep):
    found = tk.kcliques(edges_df(spark, [(1, 2), (1, 3), (2, 3), (-5, 2), (-5, 3)]), 3)
    path = tk.write_cliques(found, str(tmp_path / "out"), sep=sep)
    assert any(p.name.endswith(".txt.gz") for p in Path(path).iterdir())
    back = tk.read_cliques(spark, path, sep)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, found.collect()))


def test_maximal_text_round_trip_with_run_id(spark, tmp_path):
    found = tk.maximal_cliques(edges_df(spark, [(1, 2), (1, 3), (2, 3), (3, 4)]))
    path = tk.write_maximal(found, str(tmp_path / "out"), run_id="r1")
    assert path.endswith("out_r1")
    lines = sorted(x for p in Path(path).glob("part-*") for x in p.read_text().splitlines())
    assert lines == ["3\t1 2 3", "4\t3 4"]
    assert sorted(map(tuple, tk.read_maximal(spark, path).collect())) == sorted(map(tuple, found.collect()))
    stamped = tk.write_maximal(found, str(tmp_path / "out"), compression="gzip", run_id="now")
    assert len(stamped.rsplit("_", 1)[1]) == 10
    assert any(p.name.endswith(".gz") for p in Path(stamped).iterdir())


def test_stored_edge_list_scans_its_file_once(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text(MESSY + "abc 5\n7\n9223372036854775807 1\n9223372036854775808 1\n")
    rows = edge_list_rows(spark.read.text(str(path)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and plan.count("Exchange") == 1
    found, lazy = (tk.read_edge_list(spark, str(path), stored=stored) for stored in (True, False))
    assert pairs_of(found.edges) == pairs_of(lazy.edges)
    assert sorted(r.v for r in found.vertices.collect()) == sorted(r.v for r in lazy.vertices.collect())
    assert sorted(map(tuple, found.rejects.collect())) == sorted(map(tuple, lazy.rejects.collect()))
    assert len(found.rejects.collect()) == 5
    path.write_text("")
    assert all(part.collect() == [] for part in tk.read_edge_list(spark, str(path), stored=True))


def test_stored_edge_list_fails_fast(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text("7\n1 2\n")
    found = tk.read_edge_list(spark, str(path), "FAILFAST", stored=True)
    assert pairs_of(found.edges) == [(1, 2)] and found.rejects.count() == 1
    path.write_text(MESSY)
    with pytest.raises(PySparkException):
        tk.read_edge_list(spark, str(path), "FAILFAST", stored=True)


def test_bad_adjacency_lines_are_rejected_whole(spark):
    lines = ["# 1 2", "", " 1 2\t3 ", "2 1 x3", "a", "4", "3 9223372036854775808", "-5 1"]
    found = tk.check_adjacency_lines(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert sorted((r.v, r.nbrs) for r in found.lists.collect()) == [(-5, [1]), (1, [2, 3]), (4, [])]
    assert sorted(tuple(r) for r in found.rejects.collect()) == [
        (line, "not numeric") for line in sorted(["2 1 x3", "a", "3 9223372036854775808"])]


def test_one_sided_arcs(spark):
    lists = [(1, [2, 3, 3, 1]), (2, [1]), (2, [4]), (4, [2]), (5, [1, 6]), (6, [])]
    found = tk.one_sided(spark.createDataFrame(lists, "v bigint, nbrs array<bigint>"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3), (5, 1), (5, 6)]


@pytest.mark.parametrize("bound", [1 << 17, 2])
def test_checked_lists_stop_a_job_on_a_fault(spark, bound):
    adj = tk.stable(tk.adjacency(edges_df(spark, [(1, 2), (1, 3), (2, 3), (1, 4), (1, 5)]), list_bound=bound))
    assert sorted(map(tuple, tk.checked_lists(adj).collect())) == sorted(map(tuple, adj.collect()))
    faults = {
        "comes twice": adj.unionByName(adj.filter("v = 1 and part = 0")),
        "as many ids": adj.withColumn("degree", F.col("degree") + (F.col("v") == 3).cast("int")),
        "not ascending": adj.withColumn("nbrs", F.reverse("nbrs")),
    }
    for text, faulty in faults.items():
        with pytest.raises(PySparkException, match=text):
            tk.checked_lists(faulty).select("v").collect()


def test_lines_are_split_once(spark):
    """Filters on tokens or ids do not make the line be split, or its ids be read, a second time."""
    lines = spark.createDataFrame([("1 2 3",), ("# 2 1",), ("2 x",), ("3 1",), ("  ",)], "value string")
    checked = tk.check_adjacency_lines(lines)
    for found in (tk.one_sided(checked.lists), checked.rejects, tk.parse_edge_lines(lines).rejects):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [tuple(r) for r in tk.one_sided(checked.lists).collect()] == [(1, 2)]
    assert [r.line for r in checked.rejects.collect()] == ["2 x"]
