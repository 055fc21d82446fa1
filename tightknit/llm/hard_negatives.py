"""Hard negatives by slots of scores.

An anchor's positives are the upper limits of its windows of scores, and windows overlap. The limits split the scores
into disjoint slots instead: slot j holds the scores from its own limit down to the next lower one, or to the end of
the windows that reach it. Every row then falls into one slot of an anchor at most, tasks keep the first k rows of a slot
(a combiner), and partial firsts of many tasks reduce to the same k. Read from the lowest slot up, the first k of a slot and what is
merged below it are the first k of all that lies under its limit, which answers every window from one list a slot.

Anchors are a stated query set against all rows. Both sides are dealt into blocks of bounded bytes, and a
task meets one block of each; blocks of anchors go in waves, so that the copies of rows under way stay bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tightknit.plans.stable import drop_table, stable, stable_measured

#: Components of a block of rows and of a block of anchors.
ROW_VALUES, ANCHOR_VALUES = 1 << 22, 1 << 20

#: Blocks of anchors met in one job, which is how often a row travels in it.
WAVE = 4

#: Rows and anchors whose scores are held at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 512

#: Scores stay below this, so that percentages of them fit in 64 bits.
SCORE_BOUND = 1 << 56

#: No score reaches it.
BEYOND = 1 << 62


def usable_vectors(
    vectors: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, label, q``: rows that can take part, one an id, components as ``floor(scale * x)``.

    Rows with a null id, label or vector or a null or non-finite component are left out. Of
    different rows of one id the one with the least label, then the least vector, stands for it.
    """
    infinite = F.lit(float("inf"))
    values = vectors[vector].cast("array<double>")
    unfit = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    largest = F.lit((1 << 31) - 1).cast("bigint")
    q = F.transform(values, lambda x: F.greatest(F.least(F.floor(x * scale), largest), -largest).cast("int"))
    found = vectors.select(
        vectors[vec_id].cast("bigint").alias("vec_id"), vectors[label].cast("bigint").alias("label"), q.alias("q"), unfit.alias("unfit")
    )
    found = found.where("vec_id is not null and label is not null and not unfit")
    least = F.min(F.struct("label", "q")).alias("least")
    return found.groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.q")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    n_positives: int = 5,
    n_negatives: int = 5,
    percent: int = 80,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    relabel: Column | None = None,
    row_values: int = ROW_VALUES,
    anchor_values: int = ANCHOR_VALUES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` selects rows by ``vec_id``; ``relabel`` gives other labels from ``vec_id`` and ``label``. Scores are
    integer inner products of ``floor(scale * x)``. An anchor's positives are its first ``n_positives`` other rows of its
    label, higher scores first, ties by smaller id; for each the first ``n_negatives`` rows of other labels with
    ``percent`` to 100 percent of its score come out, so a negative score has none.

    An empty table gives no rows. Vectors of different lengths meet as if zeros followed the shorter one, an empty one
    scores 0. Components beyond what keeps every score under 2^56 are cut to that bound.
    """
    rows = usable_vectors(vectors, scale, vec_id, vector, label)
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows, seen = stable_measured(
        rows,
        n=F.count(F.lit(1)),
        dim=F.max(F.size("q")),
        largest=F.max(F.greatest(F.array_max("q"), -F.array_min("q"))),
    )
    dim = max(seen["dim"], 1)
    limit = isqrt(SCORE_BOUND // dim)
    reach = min(seen["largest"], limit) ** 2 * dim
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    chosen = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("anchor_q"))
    n_anchors = chosen.count()
    n_shards = max(1, -(-seen["n"] * dim // row_values))
    n_blocks = max(1, -(-n_anchors * dim // anchor_values))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        full = np.zeros((len(lists), dim), kind)
        full[np.arange(dim) < sizes[:, None]] = np.clip(lists.flatten().to_numpy(), -limit, limit)
        return full

    def met(chosen: DataFrame, scan: Callable, schema: str) -> DataFrame:
        """``scan`` over every pair of a block of rows and a block of anchors."""
        shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).alias("shard")
        block = F.pmod(F.xxhash64("anchor_id"), F.lit(n_blocks)).alias("block")

        def numbers(first: int, last: int) -> Column:
            return F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))

        found = []
        for first in range(0, n_blocks, WAVE):
            last = min(first + WAVE, n_blocks) - 1
            dealt = rows.select("*", shard, F.explode(numbers(first, last)).alias("block"))
            asked = chosen.select("*", block).where(F.col("block").between(first, last))
            asked = asked.select("*", F.explode(numbers(0, n_shards - 1)).alias("shard"))
            both = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
            found.append(stable(both.applyInArrow(scan, schema)))
        return reduce(DataFrame.unionByName, found)

    def pieces(asked: pa.Table, dealt: pa.Table):
        """Anchors in pieces, each with all rows in pieces: index of the anchors, and scores as they come."""
        x, ids, labels = matrix(dealt["q"]), dealt["vec_id"].to_numpy(), dealt["label"].to_numpy()
        y, own = matrix(asked["anchor_q"]), asked["anchor_label"].to_numpy()

        def scored(a: slice):
            for i in range(0, len(x), ROWS_AT_ONCE):
                r = slice(i, i + ROWS_AT_ONCE)
                yield x[r] @ y[a].T, ids[r], labels[r][:, None] == own[a]

        for j in range(0, len(y), ANCHORS_AT_ONCE):
            a = slice(j, j + ANCHORS_AT_ONCE)
            yield a, scored(a)

    def first_positives(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        anchor_ids, out = asked["anchor_id"].to_numpy(), []
        for a, scores in pieces(asked, dealt) if len(dealt) and len(asked) else ():
            own, firsts = anchor_ids[a], _Firsts(len(anchor_ids[a]), n_positives, kind)
            for score, ids, same in scores:
                i, j = np.nonzero(same & (score >= firsts.least) & (ids[:, None] != own))
                firsts.add(j, score[i, j], ids[i])
            out.append((own[firsts.cell], firsts.score, firsts.ids))
        return _table(out, ["anchor_id", "score", "other_id"])

    def first_negatives(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        anchor_ids, out = asked["anchor_id"].to_numpy(), []
        limits = asked["limits"].to_pylist()
        for a, scores in pieces(asked, dealt) if len(dealt) and len(asked) else ():
            upper, lower = _slots(limits[a], n_positives, percent, kind)
            firsts = _Firsts(upper.size, n_negatives, kind)
            highest = upper.max(axis=1)
            for score, ids, same in scores:
                floor = np.maximum(lower, firsts.least.reshape(upper.shape))
                i, j = np.nonzero(~same & (score <= highest) & (score >= floor.min(axis=1)))
                value = score[i, j]
                slot = (value[:, None] <= upper[j]).sum(axis=1) - 1
                fits = value >= floor[j, slot]
                firsts.add((j * n_positives + slot)[fits], value[fits], ids[i][fits])
            j, slot = np.divmod(firsts.cell, n_positives)
            out.append((anchor_ids[a][j], firsts.score, firsts.ids, upper[j, slot]))
        return _table(out, ["anchor_id", "score", "other_id", "upper"])

    partial = met(chosen, first_positives, "anchor_id bigint, score bigint, other_id bigint")
    positive = F.struct(F.col("score"), (-F.col("other_id")).alias("minus_id"))
    positives = stable(
        _firsts(partial, ["anchor_id"], n_positives)
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(positive), asc=False).alias("positives"))
    )
    limited = chosen.join(positives.select("anchor_id", F.array_distinct("positives.score").alias("limits")), "anchor_id")
    partial = met(stable(limited), first_negatives, "anchor_id bigint, score bigint, other_id bigint, upper bigint")
    drop_table(rows)
    slots = _firsts(partial, ["anchor_id", "upper"], n_negatives).groupBy("anchor_id", "upper").agg(
        F.sort_array(F.collect_list(positive), asc=False).alias("firsts")
    )
    # From the lowest slot up: the first ones of a slot, then those merged below it.
    kind_of_list = "array<struct<score:bigint,minus_id:bigint>>"

    def merge(merged: Column, slot: Column) -> Column:
        below = F.coalesce(F.get(merged, F.lit(0))["firsts"], F.array().cast(kind_of_list))
        joined = F.slice(F.concat(slot["firsts"], below), 1, n_negatives)
        return F.concat(F.array(F.struct(slot["upper"].alias("upper"), joined.alias("firsts"))), merged)

    start = F.array().cast(f"array<struct<upper:bigint,firsts:{kind_of_list}>>")
    merged = slots.groupBy("anchor_id").agg(
        F.aggregate(F.sort_array(F.collect_list(F.struct("upper", "firsts"))), start, merge).alias("merged")
    )
    answered = positives.join(merged, "anchor_id").select("anchor_id", "merged", F.explode("positives").alias("p"))
    under = F.get(F.filter("merged", lambda slot: slot["upper"] <= F.col("p.score")), F.lit(0))["firsts"]
    within = F.filter(under, lambda n: n["score"] * 100 >= F.col("p.score") * percent)
    return answered.select("anchor_id", "p", F.posexplode(within).alias("place", "n")).select(
        "anchor_id",
        (-F.col("p.minus_id")).alias("positive_id"),
        (F.col("place") + 1).alias("rank"),
        (-F.col("n.minus_id")).alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )


def _firsts(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of every key; sorted groups, cut before they are shuffled too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _slots(limits: list[list[int]], width: int, percent: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Upper limit and least score of every slot, by descending limits; slots beyond an anchor's own hold nothing."""
    upper = np.full((len(limits), width), -BEYOND, kind)
    lower = np.full((len(limits), width), BEYOND, kind)
    for row, own in enumerate(limits):
        own = [u for u in own if u >= 0]
        upper[row, : len(own)] = own
        lower[row, : len(own)] = [max(-(-u * percent // 100), after + 1) for u, after in zip(own, own[1:] + [-1])]
    return upper, lower


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    none = np.zeros(0, np.int64)
    return pa.table({name: np.concatenate([none, *(p[i].astype(np.int64) for p in parts)]) for i, name in enumerate(names)})


class _Firsts:
    """The first k of every cell seen so far, and the score that a row must reach to count."""

    def __init__(self, n_cells: int, k: int, kind: type):
        self.k = k
        self.cell, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n_cells, -BEYOND, kind)

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(cell):
            return
        cell, ids = np.concatenate([self.cell, cell]), np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((ids, -score, cell))
        cell = cell[order]
        place = np.arange(len(cell)) - np.searchsorted(cell, cell, side="left")
        kept = place < self.k
        self.cell, self.score, self.ids = cell[kept], score[order[kept]], ids[order[kept]]
        last = place[kept] == self.k - 1
        self.least[self.cell[last]] = self.score[last]
