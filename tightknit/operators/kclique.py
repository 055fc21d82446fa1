"""k-cliques: counts, listings and histograms.

Every job grows cliques level by level. A frontier row holds a clique and
``ext``, the vertices above its last member that are adjacent to all of it, in
rank order. One level explodes ``ext`` to the vertex that joins next, fetches
that vertex's list with an equi-join and intersects it with the rest of ``ext``.
The last level is never built: its size is the sum of the ``ext`` sizes.

Strategies differ only in how the level step fetches a list:

* ``join``       a shuffle join with the ranked lists, keyed by vertex.
* ``ego``        a shuffle join with the lists restricted to the neighborhood of
  the clique's first member, keyed by (first member, vertex). A hub's rows
  spread over all the neighborhoods it occurs in. To restrict them, the shorter of
  two lists travels to the longer one.
* ``bitmap``     as ``ego``, but inside a neighborhood vertices are places and
  sets of them bitmaps (``operators/bitmaps.py``): for dense neighborhoods the
  lists are many times smaller, and a level is an AND of words.
* ``broadcast``  the ranked lists of vertices that are in other lists are broadcast if
  their measured size is within ``max_broadcast_bytes``; otherwise as ``join``.
* ``auto``       ``broadcast`` within that bound, ``ego`` beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.functions.arrays import after, computed, empty_list, ordered_intersect
from tightknit.operators.closures import met_wedges
from tightknit.operators.core import prune_core
from tightknit.operators.graph import vertices_of
from tightknit.plans.dealing import deal
from tightknit.plans.ranked import RankedGraph, rank_graph
from tightknit.plans.stable import MAX_BROADCAST_BYTES, fetch_side, stable, stable_measured

STRATEGIES = ("auto", "join", "broadcast", "ego", "bitmap")

# Jobs take canonical edges, or a graph ranked once for many of them: its order is then theirs.
Graph = DataFrame | RankedGraph

# Candidates of one list that a single task unfolds.
PIECE = 1 << 12

# Bytes of unfolded lists that one task makes.
TASK_BYTES = 128 << 20

# Peeling stops with a round that takes no more than this share of the edges.
PEEL_SHARE = 0.01


def init_frontier(lists: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """First states ``(clique, ext)``: every vertex with the neighbors that can join it.

    ``lists`` are the ranked lists ``rank_graph(...).out``, which hold each list
    in one row. ``vertices`` adds a state for every vertex without one.
    """
    _check_whole(lists)
    states = lists.select("v", F.col("nbrs").alias("ext"))
    if vertices is not None:
        bare = vertices.select("v").distinct().join(lists.select("v"), "v", "left_anti")
        states = states.unionByName(bare.select("v", empty_list().alias("ext")))
    return states.select(F.array("v").alias("clique"), "ext")


def bound_prune(frontier: DataFrame, k: int) -> DataFrame:
    """Keep the states that can still reach size k."""
    return frontier.filter(F.size("clique") + F.size("ext") >= k)


def expand(
    frontier: DataFrame, lists: DataFrame, longest: int | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """All children ``(clique, ext)`` of all states, for the ranked lists they started from.

    What is adjacent to a candidate and still possible stands behind it in ``ext``. ``longest`` is the length of the
    longest list, ``rank_graph(...).longest``; without it states are shuffled once more, as some could be long.
    The ids that have a list are stored and measured: within ``max_broadcast_bytes`` they are broadcast, and candidates
    without one are not shuffled.
    """
    _check_whole(lists)
    fan = unfold(frontier, "ext", longest)
    rest, fetched = after("ext", "pos").alias("rest"), lists.select(F.col("v").alias("w"), "nbrs").hint("merge")
    ids, seen = stable_measured(lists.select(F.col("v").alias("w")), n_bytes=F.count(F.lit(1)) * 64)
    if seen["n_bytes"] > max_broadcast_bytes:
        return _children(fan.select("clique", "w", rest).join(fetched, "w", "left"))
    ids = F.broadcast(ids)
    grown = _children(fan.join(ids, "w", "left_semi").select("clique", "w", rest).join(fetched, "w"))
    ended = fan.select("clique", "w").join(ids, "w", "left_anti")
    return grown.unionByName(ended.select(F.array_append("clique", F.col("w")).alias("clique"), empty_list().alias("ext")))


def _children(met: DataFrame) -> DataFrame:
    return computed(
        met,
        [F.array_append("clique", F.col("w")).alias("clique")],
        ext=ordered_intersect("rest", F.coalesce("nbrs", empty_list())),
    )


def count_kcliques(
    edges: Graph,
    k: int,
    strategy: str = "auto",
    order: str = "degree",
    vertices: DataFrame | None = None,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    peel: bool = False,
) -> DataFrame:
    """``(clique_size, n_cliques)`` for size k, in one row. With ``peel`` only the (k-1)-core is ranked."""
    _check(k, strategy)
    if k == 1:
        return _size_row(_all_vertices(edges, vertices).agg(F.count(F.lit(1)).alias("n")), 1)
    if k == 2:
        return _size_row(_all_edges(edges).agg(F.count(F.lit(1)).alias("n")), 2)
    graph = ranked(peeled(edges, k, peel), order, seed, num_partitions)
    levels = _levels(graph, k, strategy, max_broadcast_bytes, num_partitions=num_partitions)
    return _size_row(levels[k - 1].agg(_n_ext(levels[k - 1]).alias("n")), k)


def triangle_count(edges: Graph, strategy: str = "auto", order: str = "degree", **options) -> DataFrame:
    """``(n_triangles)``; ``options`` as for ``count_kcliques``."""
    return count_kcliques(edges, 3, strategy, order, **options).select(F.col("n_cliques").alias("n_triangles"))


def clique_histogram(
    edges: Graph,
    k: int,
    strategy: str = "auto",
    order: str = "degree",
    vertices: DataFrame | None = None,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``(clique_size, n_cliques)`` for every size 1..k, zero counts included.

    Each level in between is a stored table, counted and grown from there, so that no list
    is intersected twice.
    """
    _check(k, strategy)
    parts = [count_kcliques(edges, size, vertices=vertices) for size in range(1, min(k, 2) + 1)]
    if k > 2:
        graph = ranked(edges, order, seed, num_partitions)
        levels = _levels(
            graph, k, strategy, max_broadcast_bytes, prune=False, num_partitions=num_partitions
        )
        parts += [
            _size_row(levels[size - 1].agg(_n_ext(levels[size - 1]).alias("n")), size)
            for size in range(3, k + 1)
        ]
    return _union(parts)


def kcliques(
    edges: Graph,
    k: int,
    strategy: str = "auto",
    order: str = "degree",
    vertices: DataFrame | None = None,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    peel: bool = False,
    compact: bool = False,
) -> DataFrame:
    """All k-cliques: ``(clique, clique_size, anchor)``, members ascending, anchor = smallest.

    With ``peel`` only the (k-1)-core is ranked. With ``compact`` the listing has a row ``(prefix, ext)`` for all cliques
    of k - 1 members ``prefix`` and one of ``ext``: ``expand_compact`` and the sinks write them out.
    """
    _check(k, strategy)
    if k == 1:
        found = _all_vertices(edges, vertices)
        if compact:
            return found.select(empty_list().alias("prefix"), F.array("v").alias("ext"))
        return _clique_rows(found.select(F.array("v").alias("clique")))
    if k == 2 and not compact:
        return _clique_rows(_all_edges(edges).select(F.array("src", "dst").alias("clique")))
    graph = ranked(peeled(edges, k, peel), order, seed, num_partitions)
    if k == 2:
        return graph.out.select(F.array("v").alias("prefix"), F.col("nbrs").alias("ext"))
    levels = _levels(
        graph, k, strategy, max_broadcast_bytes, members=True, num_partitions=num_partitions
    )
    if compact:
        return levels[k - 1].select(F.col("clique").alias("prefix"), "ext")
    return _complete(levels[k - 1])


def expand_compact(listing: DataFrame) -> DataFrame:
    """``(clique, clique_size, anchor)`` of a compact listing ``(prefix, ext)``, one row for each element of ``ext``."""
    return _complete(listing.withColumnRenamed("prefix", "clique"))


def count_compact(listing: DataFrame) -> DataFrame:
    """``(clique_size, n_cliques)`` of a compact listing, which is not expanded for it."""
    sized = listing.groupBy((F.size("prefix") + 1).alias("clique_size"))
    return sized.agg(F.sum(F.size("ext")).alias("n_cliques")).filter("n_cliques > 0")


def triangles(edges: Graph, strategy: str = "auto", order: str = "degree", **options) -> DataFrame:
    """``kcliques`` of size 3, with its options."""
    return kcliques(edges, 3, strategy, order, **options)


def cliques_upto(
    edges: Graph,
    k: int,
    strategy: str = "auto",
    order: str = "degree",
    vertices: DataFrame | None = None,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """All cliques of every size 1..k: ``(clique, clique_size, anchor)``."""
    _check(k, strategy)
    parts = [kcliques(edges, size, vertices=vertices) for size in range(1, min(k, 2) + 1)]
    if k > 2:
        levels = _levels(
            ranked(edges, order, seed, num_partitions), k, strategy, max_broadcast_bytes,
            members=True, prune=False, num_partitions=num_partitions,
        )
        parts += [_complete(levels[size - 1]) for size in range(3, k + 1)]
    return _union(parts)


def cliques_per_anchor(
    edges: Graph,
    k: int,
    anchor: str = "min",
    strategy: str = "auto",
    order: str = "degree",
    vertices: DataFrame | None = None,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    peel: bool = False,
) -> DataFrame:
    """``(anchor, n_cliques)``: k-cliques counted at their smallest or largest member."""
    if anchor not in ("min", "max"):
        raise ValueError(f"anchor must be 'min' or 'max', got {anchor!r}")
    pick, closer = (F.array_min, F.least) if anchor == "min" else (F.array_max, F.greatest)
    _check(k, strategy)
    if k < 3:
        anchors = kcliques(edges, k, vertices=vertices).select(pick("clique").alias("anchor"))
    else:
        levels = _levels(
            ranked(peeled(edges, k, peel), order, seed, num_partitions), k, strategy, max_broadcast_bytes,
            members=True, num_partitions=num_partitions,
        )
        # Only the end of the finished clique is needed, so its array is not built.
        last = levels[k - 1].select(pick("clique").alias("end"), F.explode("ext").alias("w"))
        anchors = last.select(closer("end", "w").alias("anchor"))
    return anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_cliques"))


def unfold(
    rows: DataFrame, array: str, longest: int | None = None, w: str = "w", key: str | None = None, parts: int | None = None
) -> DataFrame:
    """``rows`` once per element of ``array``, with the element ``w`` and its 0-based place ``pos``.

    A row of n ids becomes n rows of up to n ids. If ``longest`` says that there may be more than
    ``PIECE`` of them, or is not given, rows are first cut into pieces that go to ``parts`` tasks:
    by the ids that come from them if a ``key`` tells the rows apart, which are then read twice, else in turn.
    """
    whole = longest is not None and longest <= PIECE
    if not whole:
        n = F.size(array)
        first = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE))).alias("first")
        rows, parts = rows.select("*", first), parts or _spread(rows)
        if key:
            made = F.least(n - F.col("first"), F.lit(PIECE)).cast("bigint") * n
            rows = deal(rows, [key, "first"], made, parts)
        else:
            rows = rows.repartition(parts)
        piece, start = F.slice(array, F.col("first") + 1, F.lit(PIECE)), F.col("first")
    else:
        piece, start = F.col(array), F.lit(0)
    kept = [c for c in rows.columns if c != "first" or whole]
    unfolded = rows.select("*", F.posexplode(piece).alias("_i", w))
    return unfolded.select(*kept, (start + F.col("_i")).alias("pos"), w)


def task_count(graph: RankedGraph, num_partitions: int | None = None) -> int:
    """Tasks for all lists unfolded once: ``num_partitions``, or by the measured ids that come from it."""
    return num_partitions or max(_spread(graph.out), -(-8 * graph.work // TASK_BYTES))


def wedges(graph: RankedGraph, behind: int, least: int = 0, num_partitions: int | None = None) -> DataFrame:
    """``(anchor, w, rest)`` for every ranked edge anchor-w.

    ``rest`` is the part of the anchor's list behind w, of at least ``behind``
    vertices. Anchors with lists of fewer than ``least`` vertices are left out.
    """
    rows = _places(graph, behind, least, num_partitions)
    return rows.select("anchor", "w", after("nbrs", "pos").alias("rest"))


def _places(graph: RankedGraph, behind: int, least: int, num_partitions: int | None) -> DataFrame:
    """``(anchor, w, pos, n_out, nbrs)``: the ``wedges`` by w's place in the anchor's list."""
    lists = graph.out.filter((F.col("n_out") > behind) & (F.col("n_out") >= least)).select("v", "n_out", "nbrs")
    parts = task_count(graph, num_partitions)
    share = graph.work // parts
    if graph.longest <= PIECE and PIECE < share < 4 * graph.longest**2:
        # Whole lists, of which one can be a quarter of a task's share or more; small shares need no dealing.
        lists = deal(lists, ["v"], F.col("n_out").cast("bigint") * F.col("n_out"), parts)
    rows = unfold(lists, "nbrs", graph.longest, key="v", parts=parts)
    rows = rows.filter(F.col("n_out") - F.col("pos") > behind)
    return rows.withColumnRenamed("v", "anchor")


def fetched_lists(graph: RankedGraph, max_broadcast_bytes: int) -> DataFrame | None:
    """The side of ``wedge_closures`` to fetch from: a broadcast, or ``None`` if it would be too large."""
    if graph.asked_bytes > max_broadcast_bytes:
        return None
    return F.broadcast(graph.asked.select("w", "nbrs"))


def wedge_closures(
    graph: RankedGraph, lists: DataFrame | None, how: str = "inner", least: int = 0, num_partitions: int | None = None,
    limit: int = 0,
) -> DataFrame:
    """``(anchor, w, ext)`` per ranked edge anchor-w: the triangles above it.

    ``ext`` lists the common higher-ranked neighbors in rank order. ``lists(w,
    nbrs)`` is the side to fetch from, ``None`` for a shuffle of the shorter lists; with ``how='inner'`` edges that
    close no triangle are left out. ``least`` is the shortest list of an anchor, ``limit`` what that shuffle may broadcast.
    """
    behind = 1 if how == "inner" else 0
    if lists is None:
        met = met_wedges(graph, _places(graph, behind, least, num_partitions), how, limit)
    else:
        met = wedges(graph, behind, least, num_partitions).join(lists, "w", how)
    ext = ordered_intersect("rest", F.coalesce("nbrs", empty_list()))
    closed = computed(met, ["anchor", "w"], ext=ext)
    return closed.filter(F.size("ext") > 0) if how == "inner" else closed


def _levels(
    graph: RankedGraph,
    k: int,
    strategy: str,
    max_broadcast_bytes: int,
    members: bool = False,
    prune: bool = True,
    num_partitions: int | None = None,
) -> dict[int, DataFrame]:
    """Frontiers by clique size, 2..k-1; ``clique`` is carried if ``members``.

    With ``prune`` states and candidates that cannot reach size k are dropped.
    """
    if strategy == "auto":
        strategy = "broadcast" if graph.asked_bytes <= max_broadcast_bytes else "ego"
    limit = max_broadcast_bytes if strategy == "broadcast" else 0
    lists = fetch_side(graph.asked.select("w", "nbrs"), graph.asked_bytes, limit)
    if strategy == "bitmap":
        from tightknit.operators import bitmaps  # which unfolds its rows as this module does

        levels = bitmaps.bitmap_levels(graph, lists, k, members, prune, num_partitions)
        return {n: bitmaps.with_ids(f, graph, max_broadcast_bytes) for n, f in levels.items()} if members else levels
    keys = ["w"]

    def missing(size: int) -> int:
        """Vertices a clique of this size still needs, at least."""
        return k - size if prune else 1

    pair = _carry(members, F.array("anchor", "w"))
    if strategy == "ego":
        # The restricted lists are the states of size 2 as well. An anchor needs k - 1 others.
        least = k - 1 if prune else 0
        local = wedge_closures(graph, None, least=least, num_partitions=num_partitions, limit=max_broadcast_bytes)
        local = stable(local) if k > 3 else local
        frontier = local.select("anchor", *pair, "ext").filter(F.size("ext") >= missing(2))
        lists, keys = local.withColumnRenamed("ext", "nbrs").hint("merge"), ["anchor", "w"]
    else:
        fan = wedges(graph, missing(2), k - 1 if prune else 0, num_partitions).select("anchor", "w", "rest", *pair)
        frontier = _meet(fan, lists, keys, missing(2), members, num_partitions)
        if not prune and k > 3:  # read again to be counted and to grow
            frontier = stable(frontier)
    levels = {2: frontier}
    for size in range(3, k):
        if strategy == "broadcast" and size == min(4, k - 1):
            # Without a shuffle join all cliques of a vertex would grow in its task.
            frontier = frontier.repartition(task_count(graph, num_partitions))
        fan = _fan(frontier, missing(size), members, graph.longest, task_count(graph, num_partitions))
        frontier = _meet(fan, lists, keys, missing(size), members, num_partitions)
        if not prune and size < k - 1:
            frontier = stable(frontier)
        levels[size] = frontier
    return levels


def _fan(frontier: DataFrame, behind: int, members: bool, longest: int, parts: int) -> DataFrame:
    """One row per candidate w that has at least ``behind`` further candidates behind it."""
    fan = unfold(frontier.select("anchor", *_carry(members, "clique"), "ext"), "ext", longest, parts=parts)
    return fan.filter(F.size("ext") - F.col("pos") > behind).select(
        "anchor", "w", after("ext", "pos").alias("rest"),
        *_carry(members, F.array_append("clique", F.col("w"))),
    )


def _meet(
    fan: DataFrame, lists: DataFrame, keys: list, missing: int, members: bool, num_partitions: int | None = None
) -> DataFrame:
    """The states after w has joined, if at least ``missing`` candidates remain."""
    if num_partitions:
        fan = fan.repartition(num_partitions, *keys)
    joined = fan.join(lists, keys)
    grown = computed(
        joined, ["anchor", *_carry(members, "clique")], ext=ordered_intersect("rest", "nbrs")
    )
    return grown.filter(F.size("ext") >= missing)


def _n_ext(level: DataFrame):
    """Cliques of the next size."""
    return F.sum("n_ext") if "n_ext" in level.columns else F.sum(F.size("ext"))


def _spread(table: DataFrame) -> int:
    return 4 * table.sparkSession.sparkContext.defaultParallelism


def _carry(members: bool, clique) -> list:
    clique = F.col(clique) if isinstance(clique, str) else clique
    return [clique.alias("clique")] if members else []


def _complete(frontier: DataFrame) -> DataFrame:
    """Cliques of the next size: one per candidate."""
    found = frontier.select("clique", F.explode("ext").alias("w"))
    return _clique_rows(found.select(F.sort_array(F.array_append("clique", F.col("w"))).alias("clique")))


def _clique_rows(cliques: DataFrame) -> DataFrame:
    return cliques.select(
        "clique", F.size("clique").alias("clique_size"), F.col("clique")[0].alias("anchor")
    )


def _size_row(total: DataFrame, size: int) -> DataFrame:
    return total.select(
        F.lit(size).alias("clique_size"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_cliques")
    )


def ranked(edges: Graph, order: str, seed: int, num_partitions: int | None) -> RankedGraph:
    """The ranked graph of ``edges``, or the one that is given in their place."""
    return edges if isinstance(edges, RankedGraph) else rank_graph(edges, order, seed, num_partitions)


def peeled(edges: Graph, k: int, peel: bool) -> Graph:
    """The edges that cliques of k members can have, if they are to be peeled and are not ranked yet."""
    if not peel or isinstance(edges, RankedGraph):
        return edges
    return prune_core(edges, k, least_share=PEEL_SHARE)


def _all_edges(edges: Graph) -> DataFrame:
    if not isinstance(edges, RankedGraph):
        return edges
    ends = edges.out.select("v", F.explode("nbrs").alias("w"))
    return ends.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"))


def _all_vertices(edges: Graph, vertices: DataFrame | None) -> DataFrame:
    found = edges.vertices.select("v") if isinstance(edges, RankedGraph) else vertices_of(edges)
    return found if vertices is None else found.unionByName(vertices.select("v")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _check_whole(lists: DataFrame) -> None:
    if "part" in lists.columns:
        raise ValueError("states need whole lists: pass rank_graph(edges, order).out")


def _check(k: int, strategy: str) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
