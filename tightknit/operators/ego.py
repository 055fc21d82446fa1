"""Ego networks: the edges among the neighbors of each vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.operators.kclique import Graph, triangles


def ego_network(edges: Graph, above: bool = False, **options) -> DataFrame:
    """``(anchor, a, b)``: the edges a-b, a < b, between neighbors of each anchor.

    An edge between two neighbors of a vertex is a triangle seen from that
    vertex, so each triangle gives three rows. With ``above`` only the row whose
    anchor is the smallest member is kept. ``options`` are those of ``triangles``.
    """
    found = triangles(edges, **options).select(*(F.col("clique")[i].alias(c) for i, c in enumerate("xyz")))
    views = [("x", "y", "z")] if above else [("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")]
    rows = F.array(
        *(
            F.struct(F.col(v).alias("anchor"), F.col(a).alias("a"), F.col(b).alias("b"))
            for v, a, b in views
        )
    )
    return found.select(F.inline(rows))
