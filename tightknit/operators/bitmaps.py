"""Neighborhoods as bitmaps.

Inside the neighborhood of an anchor a vertex is its place in the anchor's ranked list, and a set of vertices is a bitmap over
these places: an array of 64-bit words from word ``start`` to the end of the list. A list costs a bit a place in
place of eight bytes an id, an intersection is an AND of words, a size a count of bits. Only listings turn places back into
ids, once, by the anchor's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tightknit.functions.arrays import after, computed, let, ordered_intersect
from tightknit.operators.kclique import task_count, unfold
from tightknit.plans.ranked import RankedGraph
from tightknit.plans.stable import fetch_side, stable

WORD = 64

# Places whose words share one search for the members among them.
BLOCK = WORD * WORD


def bit_words(places: Column, chosen: Column) -> Column:
    """The bitmap of ``chosen``, ids of the list ``places``; empty for an empty list.

    Block by block and word by word, so that an id is compared with those of its own word only.
    """

    def word(ids: Column, own: Column) -> Column:
        bit = lambda found, b: found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position(ids, b) - 1).cast("int")))
        return F.aggregate(F.array_intersect(own, ids), F.lit(0).cast("bigint"), bit)

    def words(block: Column) -> Column:
        own = F.array_intersect(chosen, block)
        return let(own, lambda own: F.transform(_cuts(block, WORD), lambda ids: word(ids, own)))

    return F.flatten(F.transform(_cuts(places, BLOCK), words))


def _cuts(array: Column, size: int) -> Column:
    """``array`` in pieces of ``size``, the last one shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.slice(array, i, F.lit(size))), lambda piece: F.size(piece) > 0)


def bit_places(words="words", start="start") -> Column:
    """The places of the set bits, ascending."""
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))

    def of_word(word: Column, k: Column) -> Column:
        held = F.filter(bits, lambda b: F.call_function("shiftright", word, b).bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return F.transform(held, lambda b: (F.col(start) + k) * WORD + b)

    return F.flatten(F.transform(words, of_word))


def bit_size(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, word: n + F.bit_count(word))


def local_bitmaps(graph: RankedGraph, lists: DataFrame, least: int = 0, num_partitions: int | None = None) -> DataFrame:
    """``(anchor, place, w, start, words, n_ext)`` for every ranked edge anchor-w that closes a triangle.

    ``place`` is that of w in the anchor's list; the bitmap holds the common higher-ranked neighbors, all of them
    behind it. ``lists(w, nbrs)`` is the side to fetch from, ``least`` the shortest list of an anchor.
    """
    anchors = graph.out.filter((F.col("n_out") > 1) & (F.col("n_out") >= least))
    anchors = anchors.select("v", "n_out", F.col("nbrs").alias("own"))
    rows = unfold(anchors, "own", graph.longest, key="v", parts=task_count(graph, num_partitions))
    rows = rows.filter(F.col("n_out") - F.col("pos") > 1)
    start = F.floor(F.col("pos") / WORD).cast("int")
    common = ordered_intersect(after("own", "pos"), "nbrs")
    met = computed(
        rows.join(lists, "w"),
        [F.col("v").alias("anchor"), F.col("pos").alias("place"), "w", start.alias("start"), "own"],
        ext=common,
    ).filter(F.size("ext") > 0)
    covered = F.slice("own", F.col("start") * WORD + 1, F.size("own"))
    return met.select(
        "anchor", "place", "w", "start", bit_words(covered, F.col("ext")).alias("words"), F.size("ext").alias("n_ext")
    )


def bitmap_levels(
    graph: RankedGraph, lists: DataFrame, k: int, members: bool, prune: bool, num_partitions: int | None = None
) -> dict[int, DataFrame]:
    """Frontiers ``(anchor, start, words, n_ext)`` by clique size, 2..k-1, with ``clique`` if ``members``.

    With ``prune`` states and candidates that cannot reach size k are dropped, else levels are stored to be counted and grown.
    """

    def missing(size: int) -> int:
        return k - size if prune else 1

    local = stable(local_bitmaps(graph, lists, k - 1 if prune else 0, num_partitions))
    met = local.select(F.col("anchor"), "place", "w", F.col("words").alias("of_place")).hint("merge")
    pair = [F.array("anchor", "w").alias("clique")] if members else []
    frontier = local.select("anchor", "start", "words", "n_ext", *pair).filter(F.col("n_ext") >= missing(2))
    levels = {2: frontier}
    for size in range(3, k):
        fan = _fan(frontier.drop("n_ext"), graph.longest, missing(size))
        if num_partitions:
            fan = fan.repartition(num_partitions, "anchor", "place")
        joined = fan.join(met, ["anchor", "place"])
        at = F.floor(F.col("place") / WORD).cast("int")
        # Both end with the anchor's list, and the fetched one begins with the word of its place.
        behind = F.slice("words", at - F.col("start") + 1, F.size("words"))
        longer = [F.array_append("clique", F.col("w")).alias("clique")] if members else []
        grown = computed(
            joined, ["anchor", at.alias("start"), *longer],
            words=F.zip_with(behind, "of_place", lambda a, b: a.bitwiseAND(b)),
        )
        frontier = computed(grown, [*grown.columns], n_ext=bit_size("words")).filter(F.col("n_ext") >= missing(size))
        if not prune and size < k - 1:
            frontier = stable(frontier)
        levels[size] = frontier
    return levels


def _fan(frontier: DataFrame, longest: int, behind: int) -> DataFrame:
    """One row per candidate ``place``, but for those that have surely fewer than ``behind`` others behind them.

    Words are unfolded to rows and bits to rows that a filter meets at once, without a list of places in between.
    """
    rows = unfold(frontier.withColumn("n_words", F.size("words")), "words", longest // WORD + 1, w="word")
    bits = F.array(*(F.lit(b) for b in range(WORD)))
    rows = rows.select("*", F.explode(bits).alias("bit"))
    from_bit = F.call_function("shiftright", "word", "bit")
    others = F.bit_count(F.shiftrightunsigned(from_bit, 1)) + (F.col("n_words") - F.col("pos") - 1) * WORD
    kept = rows.filter((from_bit.bitwiseAND(F.lit(1).cast("bigint")) == 1) & (others >= behind))
    place = (F.col("start") + F.col("pos")) * WORD + F.col("bit")
    return kept.withColumn("place", place).drop("n_words", "word", "pos", "bit")


def with_ids(frontier: DataFrame, graph: RankedGraph, max_broadcast_bytes: int) -> DataFrame:
    """``(anchor, clique, ext)`` of a frontier of bitmaps: the candidates as ids."""
    own = fetch_side(graph.out.select(F.col("v").alias("anchor"), "nbrs"), graph.n_bytes, max_broadcast_bytes)
    named = F.transform(bit_places(), lambda place: F.get("nbrs", place))
    return frontier.join(own, "anchor").select("anchor", "clique", named.alias("ext"))
