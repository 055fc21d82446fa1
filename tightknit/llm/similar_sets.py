"""Exact Jaccard links inside groups of candidate sets, without rows for pairs.

A candidate component of up to ``BLOCK`` sets is compared in one task, many
small ones together. A larger one is cut into blocks, and each pair of blocks is
a unit of its own, so that the work of a hot component spreads over many tasks and
a task never holds more than two blocks. A unit returns a row for each of its
sets: how much it is linked to, and one linked set, its parent in a spanning forest of the unit's links, so that the
components of these are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: Columns multiplied at once when two blocks are compared.
COLUMNS = 4096


def candidate_edges(labelled: DataFrame) -> DataFrame:
    """``a, b``: each set of a label's group with the smallest of that group, from ``sid, labels``."""
    held = labelled.select("sid", F.explode("labels").alias("label"))
    least = held.groupBy("label").agg(F.min("sid").alias("b"), F.max("sid").alias("most")).where("b <> most")
    return held.join(least.select("label", "b"), "label").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()


def placed(members: DataFrame) -> DataFrame:
    """``sid, component, block, n_blocks`` from ``node, root``; blocks by a hash of the set."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return members.join(sizes, "root").select(
        F.col("node").alias("sid"),
        F.col("root").alias("component"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"),
    )


def linked(sets: DataFrame, threshold: float, n_bins: int) -> DataFrame:
    """``sid, n_linked, other, weakest`` from ``sid, component, block, n_blocks, weight, items``.

    ``n_linked`` sums the weights of the sets of the same component at ``threshold`` or
    above; a set has a row for each unit it is in. ``weakest`` is the least similarity of those links, null without
    any. ``items`` are distinct 64-bit values.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    units = (
        sets.withColumn("o", other)
        .withColumn("low", F.least("block", "o"))
        .withColumn("high", F.greatest("block", "o"))
        .withColumn(
            "unit",
            F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(n_bins))).otherwise(
                F.xxhash64("component", "low", "high")
            ),
        )
        .select("unit", "component", "low", "high", "block", "sid", "weight", "items")
    )

    def compare(table: pa.Table) -> pa.Table:
        return pa.table(compare_unit(table, threshold), schema=OUT)

    return units.groupBy("unit").applyInArrow(compare, "sid bigint, n_linked bigint, other bigint, weakest double")


OUT = pa.schema([("sid", pa.int64()), ("n_linked", pa.int64()), ("other", pa.int64()), ("weakest", pa.float64())])


def compare_unit(table: pa.Table, threshold: float) -> list[pa.Array]:
    columns = {n: table.column(n).to_numpy() for n in ("component", "low", "high", "block", "sid", "weight")}
    items = table.column("items").combine_chunks()
    starts, flat = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
    key = np.lexsort((columns["sid"], columns["block"], columns["high"], columns["low"], columns["component"]))
    units = ("component", "low", "high")
    # A set comes twice if the row that stands for it does.
    fresh = np.concatenate([[True], np.any([np.diff(columns[c][key]) != 0 for c in (*units, "sid")], axis=0)])
    key = key[fresh]
    cuts = np.flatnonzero(np.any([np.diff(columns[c][key]) != 0 for c in units], axis=0))
    sid, n_linked, other, weakest = [], [], [], []
    for rows in np.split(key, cuts + 1):
        pairs = columns["low"][rows[0]] != columns["high"][rows[0]]
        side = columns["block"][rows] == columns["high"][rows] if pairs else np.zeros(len(rows), bool)
        left, right = (rows[~side], rows[side]) if pairs else (rows, rows)
        sets_l, sets_r = ([flat[starts[r] : starts[r + 1]] for r in side_] for side_ in (left, right))
        shared, union = overlaps(sets_l, sets_l if left is right else sets_r)
        yes = shared >= threshold * union - 1e-6
        if not pairs:
            np.fill_diagonal(yes, False)
        parents = spanning_forest(yes, pairs)
        share = np.where(yes, shared / union, np.inf)
        sides = ((left, right, yes, share, parents[0]), (right, left, yes.T, share.T, parents[1]))
        for mine, theirs, table_, share_, parent in sides[: 1 + pairs]:
            if not len(mine) or not len(theirs):
                continue
            sid.append(columns["sid"][mine])
            n_linked.append(table_ @ columns["weight"][theirs])
            other.append(np.where(parent >= 0, columns["sid"][theirs][parent], columns["sid"][mine]))
            weakest.append(share_.min(axis=1))
    empty = [np.zeros(0, np.int64)]
    numbers = [pa.array(np.concatenate(x or empty).astype(np.int64)) for x in (sid, n_linked, other)]
    least = np.concatenate(weakest or empty).astype(np.float64)
    return [*numbers, pa.array(least, mask=np.isinf(least))]


def spanning_forest(links: np.ndarray, two_sided: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each row's set and of each column's in a forest that spans their links; -1: a root.

    ``two_sided`` links are between rows and columns, with parents of the other side. Others are symmetric; the parents
    of the rows are those of the columns.
    """
    n, m = links.shape
    up, down = np.full(n, -1), np.full(m, -1) if two_sided else None
    free, free_columns = np.ones(n, bool), np.ones(m, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        reached = np.array([root])
        while len(reached):
            found = links[reached]
            if two_sided:
                next_ = np.flatnonzero(found.any(axis=0) & free_columns)
                down[next_] = reached[found[:, next_].argmax(axis=0)]
                free_columns[next_] = False
                found, reached = links[:, next_].T, next_
            fresh = np.flatnonzero(found.any(axis=0) & free) if len(reached) else reached
            if len(fresh):
                up[fresh] = reached[found[:, fresh].argmax(axis=0)]
                free[fresh] = False
            reached = fresh
    return up, down if two_sided else up


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair how many values both sets and either of them hold."""
    n, m = len(left), len(right)
    if not n or not m:
        return np.zeros((n, m), np.float32), np.ones((n, m), np.float32)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(n), size_l), np.repeat(np.arange(m), size_r)
    if left is right:  # values of one set only make no pair
        common, held = np.unique(a, return_counts=True)
        common = common[held > 1]
    else:
        common = np.intersect1d(a, b)
    col_a, col_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if len(common):
        in_a = common[np.minimum(col_a, len(common) - 1)] == a
        in_b = common[np.minimum(col_b, len(common) - 1)] == b
    shared = np.zeros((n, m), np.float32)
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        x, y = np.zeros((n, width), np.float32), np.zeros((m, width), np.float32)
        for cells, rows, cols, inside in ((x, row_a, col_a, in_a), (y, row_b, col_b, in_b)):
            here = inside & (cols >= start) & (cols < start + width)
            cells[rows[here], cols[here] - start] = 1
        shared += x @ y.T
    return shared, size_l[:, None] + size_r[None, :] - shared
