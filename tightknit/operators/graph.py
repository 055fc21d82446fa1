"""Graph-level operators: orientation, neighbor lists, degrees, summary, ego networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tightknit.plans.stable import LIST_BOUND, MAX_BROADCAST_BYTES, fetch_side, stable, stable_measured


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(both))


def orient(pairs: DataFrame) -> DataFrame:
    """Canonical edges of arbitrary ``(src, dst)`` pairs: low to high, no loops, no duplicates."""
    return (
        pairs.filter("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def vertices_of(pairs: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct endpoints of ``pairs``, self-loop endpoints included."""
    found = pairs.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    return found.orderBy("v") if ordered else found


def degrees(edges: DataFrame) -> DataFrame:
    """``(v, degree)``; counts combine before the shuffle, so hubs cost one row per task."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def _pairs(edges: DataFrame, direction: str) -> DataFrame:
    """``(v, w)``: v and each of its neighbors in the given direction."""
    if direction == "out":
        return edges.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    if direction == "in":
        return edges.select(F.col("dst").alias("v"), F.col("src").alias("w"))
    if direction == "both":
        return symmetrize(edges).toDF("v", "w")
    raise ValueError(f"direction must be 'out', 'in' or 'both', got {direction!r}")


def adjacency(
    edges: DataFrame,
    direction: str = "both",
    vertices: DataFrame | None = None,
    list_bound: int = LIST_BOUND,
    num_partitions: int | None = None,
) -> DataFrame:
    """Sorted neighbor lists ``(v, part, degree, nbrs)``.

    ``direction`` is ``out`` (neighbors above v), ``in`` (below v) or ``both``.
    ``degree`` is the full list length. A list has a row for every ``list_bound`` neighbors: ``part`` is
    the place in the ascending list divided by it, so the parts of a vertex in order are its list, and no
    task ever holds a hub's whole list. ``vertices`` adds an empty list for every vertex that has none.
    """
    lists = _lists(_pairs(edges, direction), list_bound, num_partitions)
    if vertices is not None:
        bare = vertices.select("v").join(lists.select("v").distinct(), "v", "left_anti")
        lists = lists.unionByName(
            bare.select(
                "v", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("degree"),
                F.array().cast("array<bigint>").alias("nbrs"),
            )
        )
    return lists


def _lists(pairs: DataFrame, list_bound: int, num_partitions: int | None) -> DataFrame:
    counts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    long_lists = stable(counts.filter(F.col("degree") > list_bound))
    none_long = long_lists.isEmpty()  # then every place is in part 0, and none is needed
    short = pairs if none_long else pairs.join(long_lists, "v", "left_anti")
    dealt = short.repartition(num_partitions, "v") if num_partitions else short
    lists = dealt.groupBy("v").agg(F.sort_array(F.collect_list("w")).alias("nbrs"))
    lists = lists.select("v", F.lit(0).alias("part"), F.size("nbrs").cast("bigint").alias("degree"), "nbrs")
    if none_long:
        return lists
    placed = _places(pairs.join(long_lists, "v")).withColumn("part", F.floor(F.col("place") / list_bound).cast("int"))
    parts = placed.groupBy("v", "part").agg(
        F.max("degree").alias("degree"), F.sort_array(F.collect_list("w")).alias("nbrs")
    )
    return lists.unionByName(parts.select("v", "part", "degree", "nbrs"))


def _places(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the 0-based place of w in the ascending list of v.

    Pairs are ranged by (v, w) and numbered within a partition; what a vertex has in the
    partitions before is added. Each cut between partitions goes through one vertex at most, so
    there are no more such rows than partitions, and they can be broadcast.
    """
    ranged = stable(pairs.repartitionByRange("v", "w").withColumn("p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("v", "p").orderBy("w")) - 1
    held = ranged.groupBy("v", "p").agg(F.count(F.lit(1)).alias("n"))
    split = held.groupBy("v").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("v")
    before = F.sum("n").over(Window.partitionBy("v").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.join(split, "v", "left_semi").select("v", "p", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = ranged.withColumn("place", within).join(F.broadcast(carried), ["v", "p"], "left")
    return numbered.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("before", "p")


def neighbors(
    edges: DataFrame,
    vertices: DataFrame,
    direction: str = "both",
    list_bound: int = LIST_BOUND,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The lists of the given ``vertices(v)`` only, as ``adjacency`` gives them.

    Edges are cut down to these vertices before any list is built. The vertices are stored and measured: within
    ``max_broadcast_bytes`` they are broadcast and only their own arcs are shuffled, beyond it all are.
    """
    wanted, seen = stable_measured(vertices.select("v").distinct(), n_bytes=F.count(F.lit(1)) * 64)
    wanted = fetch_side(wanted, seen["n_bytes"], max_broadcast_bytes)
    pairs = _pairs(edges, direction).join(wanted, "v", "left_semi")
    return _lists(stable(pairs), list_bound, None)


def prune_vertices(adj: DataFrame, k: int) -> DataFrame:
    """Keep the vertices whose list is long enough to start a k-clique."""
    return adj.filter(F.col("degree") + 1 >= k)


def list_integrity(adj: DataFrame) -> DataFrame:
    """Rows, distinct (v, part), distinct v, and how many (v, part) come twice.

    On a sound table the first two agree and the last is 0; where no list is longer than the bound,
    the third agrees too.
    """
    per_key = adj.groupBy("v", "part").agg(F.count(F.lit(1)).alias("copies"))
    per_vertex = per_key.groupBy("v").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("copies") > 1).alias("twice")
    )
    return per_vertex.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_lists"),
        F.coalesce(F.sum("parts"), F.lit(0)).alias("n_keys"),
        F.count(F.lit(1)).alias("n_vertices"),
        F.coalesce(F.sum("twice"), F.lit(0)).alias("n_duplicated"),
    )


def checked_lists(adj: DataFrame) -> DataFrame:
    """``adj`` as it is, from a plan that fails if a list comes twice or is not whole.

    Checked are that no (v, part) has two rows, that the parts of a vertex hold ``degree`` ids together, and that each
    part is strictly ascending. The ids of a row come out through the checks, so no pruning can skip them. Rows
    are grouped by vertex, with what is shuffled for the lists themselves.
    """
    of_vertex, of_part = Window.partitionBy("v"), Window.partitionBy("v", "part")
    copies = F.count(F.lit(1)).over(of_part)
    held = F.sum(F.size("nbrs")).over(of_vertex)
    ascending = F.size("nbrs") < 2
    steps = F.zip_with(F.slice("nbrs", 1, F.greatest(F.size("nbrs") - 1, F.lit(0))), F.slice("nbrs", 2, F.size("nbrs")), lambda a, b: a < b)
    ascending = ascending | F.forall(steps, lambda step: F.coalesce(step, F.lit(False)))
    fault = (
        F.when(F.col("copies") > 1, "comes twice")
        .when(F.col("held") != F.col("degree"), "does not hold as many ids as its degree")
        .when(~ascending, "is not ascending")
    )
    text = F.concat(F.lit("the list of vertex "), F.col("v").cast("string"), F.lit(" "), fault)
    checked = F.when(fault.isNull(), F.col("v")).otherwise(F.raise_error(text).cast("bigint"))
    rows = adj.withColumns({"copies": copies, "held": held})
    return rows.withColumn("v", checked).select(*adj.columns)


def graph_info(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(n_vertices, n_edges, edges_per_vertex, avg_degree)`` in one row."""
    seen = degrees(edges)
    if vertices is not None:
        extra = vertices.select("v", F.lit(0).cast("bigint").alias("degree"))
        seen = seen.unionByName(extra).groupBy("v").agg(F.sum("degree").alias("degree"))
    totals = seen.agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.coalesce(F.expr("sum(degree) div 2"), F.lit(0)).alias("n_edges"),
    )
    n_vertices = F.nullif(F.col("n_vertices"), F.lit(0))
    return totals.select(
        "n_vertices",
        "n_edges",
        (F.col("n_edges") / n_vertices).alias("edges_per_vertex"),
        (2 * F.col("n_edges") / n_vertices).alias("avg_degree"),
    )
