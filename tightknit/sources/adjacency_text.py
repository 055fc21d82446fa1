"""Adjacency-list text: ``v n1 n2 ...`` per line."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tightknit.functions.arrays import computed
from tightknit.operators.graph import orient
from tightknit.sources.edge_list import NOT_NUMERIC, data_lines, is_data
from tightknit.sources.output import run_path


class AdjacencyList(NamedTuple):
    """``lists(v, nbrs)``, one row a sound line, and ``rejects(line, reason)``."""

    lists: DataFrame
    rejects: DataFrame


def check_adjacency_lines(lines: DataFrame) -> AdjacencyList:
    """``parse_adjacency_lines`` for files that can hold bad lines, which go to the rejects as a whole.

    A line is bad if any of its tokens is no 64-bit number.
    """
    ids = F.transform("tokens", lambda t: t.try_cast("bigint"))
    rows = computed(data_lines(lines), ["line"], ids=ids)
    bad = F.exists("ids", lambda i: i.isNull())
    lists = rows.filter(~bad).select(F.get("ids", F.lit(0)).alias("v"), F.slice("ids", 2, F.size("ids")).alias("nbrs"))
    return AdjacencyList(lists, rows.filter(bad).select("line", F.lit(NOT_NUMERIC).alias("reason")))


def one_sided(adj: DataFrame) -> DataFrame:
    """``(v, w)``: the arcs of ``(v, nbrs)`` lists whose other direction no list has, each once.

    A file that is to hold every edge in both lists has none. Self-loops are their own other direction. Arcs of a pair
    are counted by direction in one aggregation, which hubs reach already counted.
    """
    arcs = adj.select(F.col("v"), F.explode("nbrs").alias("w"))
    up = F.col("v") < F.col("w")
    pairs = arcs.filter("v <> w").select(F.least("v", "w").alias("low"), F.greatest("v", "w").alias("high"), up.alias("up"))
    seen = pairs.groupBy("low", "high").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    alone = seen.filter(F.col("up") != F.col("down"))
    v, w = (F.when(F.col("up"), F.col(a)).otherwise(F.col(b)) for a, b in (("low", "high"), ("high", "low")))
    return alone.select(v.alias("v"), w.alias("w"))


def parse_adjacency_lines(lines: DataFrame) -> DataFrame:
    """``(v, nbrs)`` per line; a long list may be spread over several lines of the same v."""
    # The cast fails on text; a filter moved below it must not reach comment lines.
    ids = F.transform(F.when(is_data(), F.col("tokens")), lambda t: t.cast("bigint"))
    return data_lines(lines).select(
        F.get(ids, F.lit(0)).alias("v"), F.slice(ids, 2, F.size("tokens")).alias("nbrs")
    )


def read_adjacency(spark: SparkSession, path, merge: bool = False) -> DataFrame:
    """``(v, nbrs)`` per line of the file, or with ``merge`` one ascending list per vertex.

    A list in parts has a line for each. Merging holds a vertex's whole list in one row.
    """
    found = parse_adjacency_lines(spark.read.text(path))
    if not merge:
        return found
    return found.groupBy("v").agg(F.sort_array(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


def edges_from_adjacency(adj: DataFrame) -> DataFrame:
    """Canonical edges of ``(v, nbrs)`` lists, whichever directions they hold."""
    return orient(adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("dst")))


def adjacency_line(v="v", nbrs="nbrs"):
    return F.concat_ws(" ", F.col(v).cast("string"), F.array_join(nbrs, " "))


def write_neighbor_list(
    adj: DataFrame, path: str, compression: str | None = None, run_id: str | None = None,
    num_partitions: int | None = None,
) -> str:
    """Write ``adj`` as text, one line per row; a vertex whose list has parts gets one line each."""
    line = F.when(F.size("nbrs") == 0, F.col("v").cast("string")).otherwise(adjacency_line())
    lines = adj.select(line.alias("value"))
    if num_partitions:
        lines = lines.repartition(num_partitions)
    target = run_path(path, run_id)
    lines.write.option("compression", compression or "none").text(target)
    return target
