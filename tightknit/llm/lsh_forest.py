"""MinHash LSH forest: sorted prefix tries of signatures, as one sorted table.

A set has a path in each of the forest's trees, ``depth`` MinHash values of a byte each. A tree's paths in sorted
order are its trie: the sets below a node of depth d are a run of rows whose neighbors agree in their first d values. Two
neighbors are a joint at the depth to which they agree, so the sets that meet at prefixes of d values are those connected by
joints of d or deeper, and shortening the prefixes from d to d - 1 only adds the joints of d - 1.

The table is cut into ranges, not by prefix, so that a prefix that a third of all sets share is sorted in many
tasks; the ranges' ends are joined afterwards, two rows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.llm.shingles import mix, recall
from tightknit.plans.stable import drop_table, stable


def stop_depth(trees: int, depth: int, similarity: float, target: float) -> int:
    """The longest prefix, of at most ``depth``, at which sets of this similarity meet with the target's chance."""
    for d in range(depth, 0, -1):
        if recall(similarity, trees, d) >= target:
            return d
    raise ValueError(f"{trees} trees cannot reach a recall of {target} at similarity {similarity}")


def paths(values: np.ndarray, offsets: np.ndarray, trees: int, depth: int, seed: int = 1) -> np.ndarray:
    """For each non-empty set ``trees * depth`` bytes, tree after tree.

    Values of a byte agree by chance once in 256, which adds candidates and loses none.
    """
    rng = np.random.default_rng(seed)
    short = (values >> np.uint64(32)).astype(np.uint32)
    found = np.zeros((len(offsets) - 1, trees * depth), np.uint8)
    for i in range(trees * depth):
        flip, factor = rng.integers(0, 2**32, 2, dtype=np.uint32)
        least = np.minimum.reduceat((short ^ flip) * (factor | np.uint32(1)), offsets[:-1])
        found[:, i] = mix(least.astype(np.uint64)) >> np.uint64(56)
    return found


_ROW = "sid bigint, other bigint, agree int, tree int, path binary"


def _neighbors(floor: int, depth: int):
    """For sorted rows ``sid, tree, path``: a row for each two neighbors, then the first and the last row."""
    names = ["sid", "other", "agree", "tree", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sid, tree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            path = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, depth)
            if ends is None:
                ends = [(sid[0], tree[0], path[0])] * 2
            else:
                sid, tree = np.append(ends[1][0], sid), np.append(ends[1][1], tree)
                path = np.vstack([ends[1][2], path])
            ends = [ends[0], (sid[-1], tree[-1], path[-1])]
            same = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            at = np.flatnonzero(same >= floor)
            none = pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())
            pairs = pa.array(sid[at + 1]), pa.array(sid[at]), pa.array(same[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*pairs, *none], names)
        if ends:
            sid, tree, path = zip(*ends)
            none = pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32())
            ids = pa.array(sid, pa.int64()), *none, pa.array(tree, pa.int32()), pa.array([p.tobytes() for p in path])
            yield pa.RecordBatch.from_arrays(list(ids), names)

    return run


def joints(sets: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """``a, b, agree``: neighbors of some tree and the most values to which they agree, ``floor`` or more.

    From ``sid, paths``, one row per set. The result is a stored table.
    """
    cells = sets.select("sid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "paths").select(
        "sid", "tree", F.expr(f"substring(paths, tree * {depth} + 1, {depth})").alias("path")
    )
    order = ["tree", "path", "sid"]
    run = _neighbors(floor, depth)
    found = stable(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ROW))
    # Two rows of each range, whatever the input.
    ends = found.where("agree is null").select("sid", "tree", "path")
    between = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(run, _ROW)
    pairs = found.unionByName(between).where("agree is not null and sid <> other")
    merged = stable(
        pairs.groupBy(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).agg(
            F.max("agree").alias("agree")
        )
    )
    drop_table(found)
    return merged
