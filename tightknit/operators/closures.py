"""Ranked edges and the lists at both ends, brought together by sending the shorter list to the longer one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.functions.arrays import after, empty_list
from tightknit.plans.ranked import RankedGraph
from tightknit.plans.stable import fetch_side, stable_measured

# A list of up to this many ids costs about as much to send as to ask for the other one's length.
SHORT = 8

# In-memory size of a row of ids without lists.
ROW_BYTES = 64


def met_wedges(graph: RankedGraph, rows: DataFrame, how: str = "inner", limit: int = 0) -> DataFrame:
    """``(anchor, w, rest, nbrs)``: what stands behind w in the anchor's list, and w's own list.

    ``rows(anchor, w, pos, n_out, nbrs)`` are places of w in lists. One with more than ``SHORT`` ids behind it goes to w
    by its place alone and learns how long w's list is, or with ``how='inner'`` ends there if w has none. Then the shorter
    one travels. Lengths are broadcast within ``limit``, as are the places left, with the lists they ask for.
    """
    n_rest = F.col("n_out") - F.col("pos") - 1
    rest = after("nbrs", "pos").alias("rest")
    lists, own = graph.asked.select("w", "nbrs"), graph.out.select(F.col("v").alias("anchor"), "nbrs")
    lengths = fetch_side(graph.asked.select("w", "n_w"), graph.n_asked * ROW_BYTES, limit)
    asking = rows.filter(n_rest > SHORT).select("anchor", "w", "pos", n_rest.alias("n_rest"))
    shorter = F.least("n_w", "n_rest").cast("bigint") * 8 + ROW_BYTES
    asked, seen = stable_measured(
        asking.join(lengths, "w", how), n_bytes=F.sum(F.when(F.col("n_w").isNotNull(), shorter))
    )

    def meet(places: DataFrame, table: DataFrame, key: str) -> DataFrame:
        if seen["n_bytes"] <= limit:
            return F.broadcast(places).join(table, key)
        return places.join(table.hint("merge"), key)

    fetching = asked.filter(F.col("n_w") < F.col("n_rest")).select("anchor", "w", "pos")
    fetched = meet(meet(fetching, lists, "w").withColumnRenamed("nbrs", "fetched"), own, "anchor")
    sending = asked.filter(F.col("n_w") >= F.col("n_rest")).select("anchor", "w", "pos")
    sent = meet(meet(sending, own, "anchor").select("anchor", "w", rest), lists, "w")
    short = rows.filter(n_rest <= SHORT).select("anchor", "w", rest).join(lists.hint("merge"), "w", how)
    columns = ["anchor", "w", "rest", "nbrs"]
    met = fetched.select("anchor", "w", rest, F.col("fetched").alias("nbrs"))
    met = met.unionByName(sent.select(*columns)).unionByName(short.select(*columns))
    if how == "left":
        alone = asked.filter(F.col("n_w").isNull())
        met = met.unionByName(alone.select("anchor", "w", empty_list().alias("rest"), empty_list().alias("nbrs")))
    return met
