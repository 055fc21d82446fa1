"""Peeling: vertices of small degree leave, round by round.

Every round is a stored table of the edges that are left; the one before it is dropped once it has been read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.operators.graph import degrees
from tightknit.plans.stable import drop_table, stable, stable_measured


def prune_core(edges: DataFrame, k: int, least_share: float = 0.0) -> DataFrame:
    """The edges a k-clique can have: those of the (k-1)-core, as a stored table.

    Vertices with fewer than k - 1 neighbors leave until none is left; every one that leaves can make others leave.
    With ``least_share`` peeling ends with the first round that takes no larger share of the edges, which
    leaves some edges that no k-clique has but spares the last rounds of long chains.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    now, seen = stable_measured(edges, n=F.count(F.lit(1)))
    while k > 2 and seen["n"]:
        weak = stable(degrees(now).filter(F.col("degree") < k - 1).select("v"))
        before, n = now, seen["n"]
        now, seen = stable_measured(_without(now, weak), n=F.count(F.lit(1)))
        drop_table(before)
        drop_table(weak)
        if n - seen["n"] <= least_share * n:
            break
    return now


def removal_rounds(edges: DataFrame, slack: float = 0.25) -> DataFrame:
    """``(v, round)``: in each round the vertices leave whose degree is at most ``1 + slack`` times the average.

    The average degree of any part of a graph is at most twice its degeneracy, so a vertex has no more than
    ``2 (1 + slack)`` times the degeneracy of neighbors that leave in its round or later. A round takes
    at least ``slack / (1 + slack)`` of the vertices, so rounds grow with the logarithm of their number.
    """
    # A table of its own, as every round's edges are dropped.
    now, rounds = stable(edges), []
    left, seen = stable_measured(degrees(now), n=F.count(F.lit(1)), ends=F.sum("degree"))
    while seen["n"]:
        most = (1 + slack) * seen["ends"] / seen["n"]
        rounds.append(left.filter(F.col("degree") <= most).select("v", F.lit(len(rounds)).alias("round")))
        staying, weak = left.filter(F.col("degree") > most).select("v"), rounds[-1].select("v")
        before = now
        now = stable(_without(now, weak))
        drop_table(before)
        # Vertices whose neighbors have all left stay on with none, for the next round to take.
        of_rest = staying.join(degrees(now), "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))
        left, seen = stable_measured(of_rest, n=F.count(F.lit(1)), ends=F.sum("degree"))
    if not rounds:
        return left.select("v", F.lit(0).alias("round"))
    return reduce(DataFrame.unionByName, rounds)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges with neither end in ``gone(v)``."""
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("v", end), end, "left_anti")
    return edges.select("src", "dst")
