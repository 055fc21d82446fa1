"""Maximal cliques.

Search and proof of maximality are split so that no step needs the full
neighbor list of a hub.

1. *Search.* Each vertex is the anchor of a search among its higher-ranked
   neighbors only. A state holds the clique, ``pool`` (the common neighbors of
   the clique inside that neighborhood) and ``done`` (the pool members that an
   earlier branch has dealt with). One round picks a pivot, branches on the
   candidates not adjacent to it, and intersects pool and done with the branch
   vertex's list; an empty pool means that nothing above the anchor extends the
   clique. The lists are those of the neighborhood, keyed by (anchor, vertex)
   and bounded by sqrt(2E). The pivot is any vertex of the pool; ``max`` takes the
   one adjacent to most candidates, which leaves the fewest branches, and ``last`` the
   one of highest rank, which needs no search.
2. *Proof.* A clique C found in step 1 can only be extended by vertices ranked
   below its anchor. If there are any, let u be the highest. Nothing above u
   extends C with u, so that clique has been found too, and C is what remains
   of it without its first member. Hence the maximal cliques are the found ones
   that are not another found one's remainder: a single anti-join.

Every found clique ends a maximal one in rank order, so the tables stay within
(largest clique) x (size of the result).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.functions.arrays import computed, empty_list, ordered_intersect
from tightknit.operators.graph import degrees, symmetrize
from tightknit.operators.kclique import Graph, fetched_lists, peeled, ranked, unfold, wedge_closures
from tightknit.plans.ranked import RankedGraph, rank_graph
from tightknit.plans.stable import MAX_BROADCAST_BYTES, fetch_side, list_bytes, stable, stable_measured

PIVOTS = ("none", "last", "max")

# A vertex of more neighbors has no list of them in ``is_maximal``.
HUB_DEGREE = 1 << 12

# Triangles are listed for edges to be judged if there are more of them than ends of edges divided by this.
MANY = 8

# A number of common neighbors above, and the place that breaks ties below.
COUNT = 1 << 32


def maximal_cliques(
    edges: Graph,
    pivot: bool | str = True,
    order: str = "degree",
    vertices: DataFrame | None = None,
    min_size: int = 1,
    seed: int = 0,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """All maximal cliques of at least ``min_size`` members.

    ``(clique, clique_size, anchor)``, members ascending, anchor = largest.
    ``vertices`` adds isolated vertices, each a maximal clique of size 1. ``pivot`` is ``max``, ``last``
    or ``none`` (``False``); ``True`` is ``last`` where a vertex's rank tells of its neighbors, else ``max``.
    """
    graph = ranked(edges, order, seed, num_partitions)
    found = _search(graph, pivot_rule(pivot, order), min_size, max_broadcast_bytes, num_partitions)
    # The hash leads the join key because arrays sort and compare slowly.
    key = [F.xxhash64("members").alias("hash"), "members"]
    remainders = found.filter(F.size("rest") > 1).select(F.col("rest").alias("members"))
    remainders = remainders.select(*key).distinct().hint("merge")
    cliques = found.select(*key).join(remainders, ["hash", "members"], "left_anti")
    cliques = cliques.select(F.col("members").alias("clique"))
    if vertices is not None and min_size <= 1:
        isolated = vertices.select("v").distinct().join(graph.vertices, "v", "left_anti")
        cliques = cliques.unionByName(isolated.select(F.array("v").alias("clique")))
    return cliques.select(
        "clique", F.size("clique").alias("clique_size"), F.element_at("clique", -1).alias("anchor")
    )


def pivot_rule(pivot: bool | str, order: str) -> str:
    """The name of the rule that ``pivot`` means for ranks by ``order``."""
    if isinstance(pivot, bool):
        pivot = "none" if not pivot else "max" if order in ("id", "random") else "last"
    if pivot not in PIVOTS:
        raise ValueError(f"pivot must be one of {PIVOTS} or a boolean, got {pivot!r}")
    return pivot


def maximal_histogram(
    edges: Graph, pivot: bool | str = True, order: str = "degree", vertices: DataFrame | None = None, **options
) -> DataFrame:
    """``(clique_size, n_cliques)`` over the maximal cliques; ``options`` as for ``maximal_cliques``."""
    found = maximal_cliques(edges, pivot, order, vertices, **options)
    return found.groupBy("clique_size").agg(F.count(F.lit(1)).alias("n_cliques"))


def count_maximal_k(
    edges: Graph, k: int, pivot: bool | str = True, order: str = "degree", vertices: DataFrame | None = None,
    peel: bool = False, **options
) -> DataFrame:
    """``(clique_size, n_cliques)``: the maximal cliques with exactly k members.

    The search drops branches that cannot reach k; larger cliques stay, since
    they are what shows a k-clique not to be maximal. With ``peel`` only the (k-1)-core is ranked,
    which holds all of these.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    found = maximal_cliques(peeled(edges, k, peel and k > 2), pivot, order, vertices, min_size=k, **options)
    return found.filter(F.col("clique_size") == k).agg(
        F.lit(k).alias("clique_size"), F.count(F.lit(1)).alias("n_cliques")
    )


def is_maximal(
    cliques: DataFrame,
    edges: DataFrame,
    num_partitions: int | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    hub_degree: int = HUB_DEGREE,
) -> DataFrame:
    """The rows of ``cliques(clique, ...)`` that no further vertex extends.

    An extending vertex is adjacent to every member, so the members' neighbor lists are intersected one after the other,
    the shortest first, and a clique is left alone as soon as nothing is common. Only members get a list. Hubs, vertices of
    more than ``hub_degree`` neighbors, have none: whether they are adjacent to a vertex is asked of the list of that
    vertex. What only hubs could tell goes to a join over single arcs: cliques of hubs alone, and those whose last common
    neighbors are hubs. Single vertices need no list. Edges that are extended are those of triangles: where many are asked
    for, the triangles are listed instead, so that no edge takes a list along.
    """
    keys, size = ["_hash", "_hash2"], F.size("clique")
    kept, asked = stable_measured(
        cliques.withColumns({"_hash": F.xxhash64("clique"), "_hash2": F.xxhash64(F.lit(1), "clique")}),
        pairs=F.count_if(size == 2), largest=F.max(size),
    )
    counts, seen = stable_measured(degrees(edges), ends=F.sum("degree"))
    single = kept.filter(size == 1).withColumn("v", F.col("clique")[0])
    extended = [single.join(counts, "v", "left_semi").select(*keys)]
    many = asked["pairs"] * MANY >= seen["ends"]
    if many:
        pairs = kept.filter(size == 2).withColumns({"a": F.array_min("clique"), "b": F.array_max("clique")})
        extended.append(pairs.join(_in_triangles(edges, max_broadcast_bytes, num_partitions), ["a", "b"], "left_semi").select(*keys))
    if asked["largest"] > (2 if many else 1):
        rows = kept.filter(size > (2 if many else 1)).select(*keys, F.col("clique").alias("members")).distinct()
        extended += _extended_by_lists(rows, edges, counts, keys, asked["largest"], num_partitions, max_broadcast_bytes, hub_degree)
    extended, seen = stable_measured(reduce(DataFrame.unionByName, extended).distinct(), n_bytes=F.count(F.lit(1)) * 64)
    return kept.join(fetch_side(extended, seen["n_bytes"], max_broadcast_bytes), keys, "left_anti").select(*cliques.columns)


def _in_triangles(edges: DataFrame, max_broadcast_bytes: int, num_partitions: int | None) -> DataFrame:
    """The edges ``(a, b)``, a < b, that have a common neighbor, as the side of a join."""
    graph = rank_graph(edges, num_partitions=num_partitions)
    closed = wedge_closures(
        graph, fetched_lists(graph, max_broadcast_bytes), num_partitions=num_partitions, limit=max_broadcast_bytes
    )

    def edge(v, w):
        return F.struct(F.least(v, w).alias("a"), F.greatest(v, w).alias("b"))

    anchor, w = F.col("anchor"), F.col("w")
    others = F.concat(F.transform("ext", lambda x: edge(anchor, x)), F.transform("ext", lambda x: edge(w, x)))
    found = closed.select(F.inline(F.concat(F.array(edge(anchor, w)), others))).distinct()
    found, seen = stable_measured(found, n_bytes=F.count(F.lit(1)) * 64)
    return fetch_side(found, seen["n_bytes"], max_broadcast_bytes)


def _member_lists(
    wanted: DataFrame, edges: DataFrame, counts: DataFrame, hub_degree: int, max_broadcast_bytes: int, num_partitions: int | None
) -> tuple[DataFrame, bool, bool]:
    """``(v, nbrs)`` of the ``wanted(v)`` that have neighbors, null for hubs, as the side of a join;
    whether it is broadcast, and whether there are hubs."""
    wanted, seen = stable_measured(wanted.distinct(), n_bytes=F.count(F.lit(1)) * 64)
    known = counts.join(fetch_side(wanted, seen["n_bytes"], max_broadcast_bytes), "v", "left_semi")
    is_hub = F.col("degree") > hub_degree
    known, found = stable_measured(known, hubs=F.count_if(is_hub))
    hubs, others = known.filter(is_hub).select("v"), known.filter(~is_hub).select("v")
    arcs = symmetrize(edges).toDF("v", "x").join(fetch_side(others, seen["n_bytes"], max_broadcast_bytes), "v", "left_semi")
    lists = (arcs.repartition(num_partitions, "v") if num_partitions else arcs).groupBy("v").agg(F.collect_list("x").alias("nbrs"))
    if found["hubs"]:
        lists = lists.unionByName(hubs.select("v", F.lit(None).cast("array<bigint>").alias("nbrs")))
    lists, seen = stable_measured(lists, n_bytes=F.sum(F.coalesce(F.size("nbrs"), F.lit(0)).cast("bigint") * 8 + 64))
    broadcast = seen["n_bytes"] <= max_broadcast_bytes
    return fetch_side(lists, seen["n_bytes"], max_broadcast_bytes), broadcast, found["hubs"] > 0


def _by_degree(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows(..., members)`` with their members by rising degree."""
    member = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "v")
    listed = rows.select(*keys, F.explode("members").alias("v")).join(counts, "v", "left").groupBy(*keys)
    return listed.agg(F.sort_array(F.collect_list(member))["v"].alias("members"))


def _extended_by_lists(
    rows: DataFrame, edges: DataFrame, counts: DataFrame, keys: list[str], largest: int,
    num_partitions: int | None, max_broadcast_bytes: int, hub_degree: int,
) -> list[DataFrame]:
    """The keys of the ``rows(..., members)`` of two members or more that a vertex extends, by the members' lists."""
    rows = stable(_by_degree(rows, counts, keys))
    wanted = rows.select(F.explode("members").alias("v"))
    lists, broadcast, any_hubs = _member_lists(wanted, edges, counts, hub_degree, max_broadcast_bytes, num_partitions)
    common = rows.withColumns({"common": F.lit(None).cast("array<bigint>"), "hubs": empty_list()})
    met = []
    for i in range(largest):
        fetched = common.withColumn("v", F.get("members", F.lit(i))).join(lists.withColumn("known", F.lit(True)), "v", "left")
        is_hub = F.col("known") & F.col("nbrs").isNull()
        nbrs = F.coalesce("nbrs", empty_list())  # a vertex without edges
        common = computed(
            fetched,
            [*keys, "members"],
            common=F.when(is_hub, F.col("common")).when(F.col("common").isNull(), nbrs).otherwise(F.array_intersect("common", nbrs)),
            hubs=F.when(is_hub, F.array_append("hubs", F.col("v"))).otherwise(F.col("hubs")),
        )
        common = common.filter(F.col("common").isNull() | (F.size("common") > 0))
        if not broadcast:  # every join is a shuffle
            common = stable(common)
        met.append(common.filter(F.size("members") == i + 1))
        common = common.filter(F.size("members") > i + 1)
    met = reduce(DataFrame.unionByName, met)
    extended = [met.filter(F.size("hubs") == 0).select(*keys)]
    if any_hubs:
        met = stable(met.filter(F.size("hubs") > 0))
        asked = met.filter(F.col("common").isNotNull()).select(*keys, "hubs", F.explode("common").alias("v"))
        lists, _, _ = _member_lists(asked.select("v"), edges, counts, hub_degree, max_broadcast_bytes, num_partitions)
        answered = asked.join(lists, "v", "left").select(
            *keys, F.when(F.col("nbrs").isNotNull(), F.size(F.array_except("hubs", "nbrs")) == 0).alias("adjacent")
        )
        verdicts = answered.groupBy(*keys).agg(
            F.bool_or(F.coalesce("adjacent", F.lit(False))).alias("extended"), F.bool_or(F.col("adjacent").isNull()).alias("open")
        )
        verdicts = stable(verdicts)
        unsure = verdicts.filter("open and not extended").select(*keys)
        left = met.filter(F.col("common").isNull()).select(*keys).unionByName(unsure)
        left = met.select(*keys, "members").join(left, keys, "left_semi")
        arcs = stable(symmetrize(edges).toDF("v", "x"))
        extended += [verdicts.filter("extended").select(*keys), _extended_by_arcs(left, arcs, counts, keys)]
    return extended


def _extended_by_arcs(rows: DataFrame, arcs: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the ``rows(..., members)`` that a vertex extends, by one join over arcs for each member.

    Candidates are the neighbors of the member with the fewest; each further member, by rising degree, keeps those it has
    an arc to.
    """
    wanted = stable(_by_degree(rows, counts, keys))
    largest = wanted.agg(F.max(F.size("members"))).first()[0] or 0
    probe, extended = wanted, [wanted.select(*keys).limit(0)]
    for i in range(largest):
        probe = probe.withColumn("v", F.get("members", F.lit(i)))
        on = ["v", "x"] if i else ["v"]
        probe = probe.join(arcs, on, "left_semi" if i else "inner").select(*keys, "members", "x")
        if i:
            probe = stable(probe)
        extended.append(probe.filter(F.size("members") == i + 1).select(*keys))
        probe = probe.filter(F.size("members") > i + 1)
    return reduce(DataFrame.unionByName, extended).distinct()


def _neighborhoods(graph: RankedGraph, max_broadcast_bytes: int, min_size: int = 1) -> DataFrame:
    """``(anchor, m, n_low, nbrs)``: for every higher-ranked neighbor m of an anchor,
    its neighbors inside the anchor's list, the ``n_low`` ones ranked below m
    first, the others in rank order. Anchors with too few neighbors for ``min_size`` are left
    out: they are lowest-ranked in no clique that is found or that shows one not to be maximal."""
    lists = fetched_lists(graph, max_broadcast_bytes)
    # Each triangle anchor-w-b is seen once, from w; b gets its share of it here.
    own = F.struct(F.col("w").alias("m"), "ext", F.lit(None).cast("bigint").alias("low"))
    share = F.transform(
        "ext",
        lambda b: F.struct(
            b.alias("m"), F.lit(None).cast("array<bigint>").alias("ext"), F.col("w").alias("low")
        ),
    )
    views = wedge_closures(graph, lists, "left", min_size - 1, limit=max_broadcast_bytes).select(
        "anchor", F.inline(F.concat(F.array(own), share))
    )
    ext = F.coalesce(F.first("ext", ignorenulls=True), empty_list())
    return views.groupBy("anchor", "m").agg(
        F.count("low").cast("int").alias("n_low"),
        F.concat(F.collect_list("low"), ext).alias("nbrs"),
    )


def _search(
    graph: RankedGraph, pivot: str, min_size: int, max_broadcast_bytes: int, num_partitions: int | None = None
) -> DataFrame:
    """``(members, rest)``: the cliques that nothing above their lowest-ranked member
    extends, with that member and without it, both ascending."""
    tables = search_rounds(graph, pivot, min_size, max_broadcast_bytes, num_partitions)
    finished = F.col("n_pool") == 0
    found = reduce(DataFrame.unionByName, (t.filter(finished).select("anchor", "clique") for t in tables))
    return found.select(
        F.sort_array(F.array_append("clique", F.col("anchor"))).alias("members"),
        F.sort_array("clique").alias("rest"),
    )


def search_rounds(
    graph: RankedGraph,
    pivot: str = "last",
    min_size: int = 1,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    num_partitions: int | None = None,
) -> list[DataFrame]:
    """The states ``(anchor, clique, pool, done, n_pool)`` of every round, stored; those with an empty pool are finished."""
    local = _neighborhoods(graph, max_broadcast_bytes, min_size).withColumn("n_pool", F.size("nbrs"))
    fan = _fan_bytes(F.col("n_pool"), F.col("n_low"), F.lit(1))
    local, seen = stable_measured(local, n_bytes=list_bytes("n_pool"), fan_bytes=fan)
    lists = local.select("anchor", "m", "nbrs")
    broadcast_lists = seen["n_bytes"] <= max_broadcast_bytes
    lists = fetch_side(lists, seen["n_bytes"], max_broadcast_bytes)
    # The lists are the states of size 2 as well: below m everything is done.
    table = local.select(
        "anchor",
        F.array("m").alias("clique"),
        F.col("nbrs").alias("pool"),
        F.slice("nbrs", F.lit(1), F.col("n_low")).alias("done"),
        "n_pool",
    ).filter(_alive(F.col("n_pool"), F.col("n_low"), min_size))
    finished = F.col("n_pool") == 0
    tables, n_live = [table], 1
    while n_live:
        # A few states are brought to the lists rather than all lists to them.
        few = not broadcast_lists and seen["fan_bytes"] <= max_broadcast_bytes
        grown = _branch(tables[-1].filter(~finished), local if few else lists, pivot, min_size, few, graph.longest)
        fan = _fan_bytes(F.col("n_pool"), F.size("done"), F.size("clique"))
        if num_partitions:
            grown = grown.repartition(num_partitions)
        table, seen = stable_measured(grown, n_live=F.count_if(~finished), fan_bytes=fan)
        tables.append(table)
        n_live = seen["n_live"]
    return tables


def _alive(n_pool, n_done, min_size: int):
    """Finished, or with candidates left; and large enough once all of them have joined."""
    reach = 1 + F.size("clique") + n_pool - n_done
    return ((n_pool == 0) | (n_pool > n_done)) & (reach >= min_size)


def _fan_bytes(n_pool, n_done, n_clique):
    """Bound on the in-memory size of the states' children: one row per candidate."""
    row = (2 * n_pool + n_clique).cast("bigint") * 8 + 128
    return F.sum((n_pool - n_done).cast("bigint") * row)


def _most_adjacent(
    live: DataFrame, lists: DataFrame, near: Callable[[DataFrame], DataFrame], longest: int | None
) -> DataFrame:
    """The live states with their pool's vertex ``m`` that is adjacent to most candidates (ties: the last one).

    Every vertex of a pool is looked up and counted; what the one aggregation shuffles is a number a
    state and task, as the states of a task are counted in it first.
    """
    state = ["anchor", "clique", "pool", "done"]
    live = stable(live.select(*state, F.monotonically_increasing_id().alias("state")))
    cand = computed(live, ["state", "anchor", "pool"], cand=F.array_except("pool", "done"))
    asked = near(unfold(cand, "pool", longest, w="m").select("state", "anchor", "cand", "pos", "m"))
    adjacent = F.size(F.array_intersect("cand", "nbrs")).cast("bigint")
    counted = asked.join(lists, ["anchor", "m"]).select("state", (adjacent * COUNT + F.col("pos")).alias("adjacent"))
    most = counted.groupBy("state").agg(F.max("adjacent").alias("most"))
    chosen = live.join(most, "state")
    return chosen.select(*state, F.get("pool", F.pmod("most", F.lit(COUNT)).cast("int")).alias("m"))


def _branch(
    live: DataFrame, lists: DataFrame, pivot: bool | str, min_size: int, few: bool, longest: int | None = None
) -> DataFrame:
    """Children of the live states, finished (empty pool) or with candidates left.

    With ``few`` the states are the broadcast side of the joins.
    """
    near = F.broadcast if few else lambda states: states
    lists = lists.select("anchor", "m", "nbrs")
    state = ["anchor", "clique", "pool", "done"]
    branches = F.array_except("pool", "done")
    if pivot in (True, "last", "max"):
        if pivot == "max":
            live = _most_adjacent(live, lists, near, longest)
        else:  # the last of the pool is its vertex of highest rank
            live = live.select(*state, F.try_element_at("pool", F.lit(-1)).alias("m"))
        live = near(live).join(lists, ["anchor", "m"])
        branches = F.array_except(branches, "nbrs")
    live = computed(live, state, branches=branches)
    fan = unfold(live.select(*state, "branches"), "branches", longest, w="m").select(
        "anchor", "clique", "pool", "m",
        F.concat("done", F.slice("branches", F.lit(1), F.col("pos"))).alias("done"),
    )
    child = computed(
        near(fan).join(lists, ["anchor", "m"]), ["anchor"],
        clique=F.array_append("clique", F.col("m")),
        pool=ordered_intersect("pool", "nbrs"),
        done=ordered_intersect("done", "nbrs"),
    )
    n_pool, n_done = F.size("pool"), F.size("done")
    return child.filter(_alive(n_pool, n_done, min_size)).withColumn("n_pool", n_pool)
