"""Ranked graph: edges oriented along a total vertex order, one bounded list per vertex.

Orienting every edge from the lower- to the higher-ranked endpoint makes each
clique appear exactly once, under its lowest-ranked member. Which order is used
never changes a result, only the length of the lists:

* ``degree``  rank by (degree, id). No vertex has more than sqrt(2E)
  higher-ranked neighbors, and a vertex of degree d at most 2E/d: the hubs,
  whose full neighbor lists are unbounded, have the shortest lists here.
* ``core``  rank by the round in which peeling removes the vertex, then by (degree, id). Lists are bounded by about
  twice the degeneracy of the graph, which is sqrt(2E) at most and often far below it; peeling takes rounds of jobs.
* ``id`` / ``random``  rank by id or by a seeded hash, whatever the degree. A list can be as long as the
  largest degree, so these orders are for graphs without hubs of many millions of neighbors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.operators.core import removal_rounds
from tightknit.operators.graph import degrees
from tightknit.plans.stable import list_bytes, stable, stable_measured

ORDERS = ("degree", "core", "id", "random")

# Ids per partition of the list table, in bytes.
PARTITION_BYTES = 256 << 20


class RankedGraph(NamedTuple):
    """``vertices(v, degree)`` and ``out(v, n_out, nbrs, n_below)``, both written tables.

    ``nbrs`` holds the higher-ranked neighbors in rank order, ``n_below`` counts the lower-ranked ones; vertices without
    any above have no row. ``n_bytes`` bounds the in-memory size of ``out``,
    ``longest`` the length of a list, ``work`` the sum of squared lengths: as many ids
    come from unfolding every list, each candidate with those behind it. ``asked_bytes`` and ``n_asked`` bound the size
    and rows of ``asked``, the only lists that a candidate can ask for.
    """

    vertices: DataFrame
    out: DataFrame
    n_bytes: int
    longest: int
    work: int
    asked_bytes: int
    n_asked: int

    @property
    def asked(self) -> DataFrame:
        """``(w, n_w, nbrs)``: the lists of the vertices that are in other lists. By degree most vertices are in none."""
        return self.out.filter("n_below > 0").select(F.col("v").alias("w"), F.col("n_out").alias("n_w"), "nbrs")


def rank_graph(
    edges: DataFrame,
    order: str = "degree",
    seed: int = 0,
    num_partitions: int | None = None,
) -> RankedGraph:
    """Orient canonical ``edges`` along ``order`` and collect the oriented lists."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")

    vertices, seen = stable_measured(degrees(edges), ends=F.sum("degree"))
    if not num_partitions:
        # All cores busy, and no partition above PARTITION_BYTES of ids.
        cores = edges.sparkSession.sparkContext.defaultParallelism
        num_partitions = max(cores, -(-seen["ends"] * 4 // PARTITION_BYTES))

    ranks = vertices
    if order == "core":  # read twice
        ranks = stable(vertices.join(removal_rounds(edges), "v"))
        group = F.struct("round", "degree")
    elif order == "degree":
        group = F.col("degree")
    else:
        group = F.lit(0).cast("bigint") if order == "id" else F.xxhash64(F.lit(seed), F.col("v"))

    def rank_of(end: str) -> DataFrame:
        return ranks.select(
            F.col("v").alias(end), F.struct(group, F.col("v")).alias(f"{end}_rank")
        )

    ranked = edges.join(rank_of("src"), "src").join(rank_of("dst"), "dst")
    up = F.col("src_rank") < F.col("dst_rank")
    oriented = ranked.select(
        F.when(up, F.col("src")).otherwise(F.col("dst")).alias("v"),
        F.when(up, F.col("dst_rank")).otherwise(F.col("src_rank")).alias("w"),
    )
    lists = oriented.repartition(num_partitions, "v").groupBy("v")
    out = lists.agg(F.sort_array(F.collect_list("w")).alias("w"))
    out = out.select("v", F.size("w").alias("n_out"), F.col("w.v").alias("nbrs"))
    out = out.join(vertices.hint("merge"), "v").select("v", "n_out", "nbrs", (F.col("degree") - F.col("n_out")).alias("n_below"))
    square = F.col("n_out").cast("bigint") * F.col("n_out")
    asked = F.when(F.col("n_below") > 0, F.col("n_out").cast("bigint") * 8 + 64)
    out, seen = stable_measured(
        out, n_bytes=list_bytes("n_out"), longest=F.max("n_out"), work=F.sum(square),
        asked_bytes=F.sum(asked), n_asked=F.count(asked),
    )
    return RankedGraph(vertices, out, **seen)
