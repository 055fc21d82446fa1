"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Fingerprints of at most ``bits`` differences are linked. Their 64 bits are split into groups, three for four
differences, and two linked fingerprints differ by at most one bit within one of the groups. Each group has a tree: a
node has a vantage point, and a fingerprint whose distance to it, within the group, is at most the node's
radius belongs inside, else outside. By the triangle inequality a fingerprint needs to look inside only up to
``radius + 1`` and outside only from ``radius`` on, so most branches are pruned. A fingerprint lives in one shard of a
tree and visits those that its search overlaps; shards compare what lives there with all that came, in all 64 bits.

Documents of equal fingerprint are one node. A shard hands on a spanning forest of its links, not its pairs,
and shards with too many rows are compared as blocks against blocks, each in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, id_text, offsets_of, pieces
from tightknit.llm.components import components
from tightknit.llm.shingles import mix
from tightknit.plans.stable import drop_table, stable, stable_measured

#: Fingerprints that live in one shard, about.
SHARD = 4096

#: Rows of a shard that one task compares with as many others at most.
BLOCK = 1 << 17

#: Comparisons and shingles held at once.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 18, 1 << 15

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(docs: DataFrame, *, width: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a signed number) of every row, null and empty texts as zero.

    A bit is set if it is in over half the XXH64 values of the shingles of ``width`` words, repeats included. A text of
    fewer words is one shingle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            column = piece.column(1)
            found = _fingerprints(bytes_of(column), offsets_of(column), width, seed)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return id_text(docs, text=text, doc_id=doc_id).mapInArrow(sign, "doc_id bigint, fingerprint bigint")


def simhash_components(
    docs: DataFrame,
    *,
    bits: int = 4,
    width: int = 4,
    seed: int = 42,
    shard: int = SHARD,
    block: int = BLOCK,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; ``component_id`` is the smallest id reachable by links.

    Texts without words have fingerprint zero and are linked like any other. Rows that repeat an id are rows of their
    own. A row without an id is linked too, but names no component: its component is null if it has no id at all.
    """
    signed = stable(fingerprints(docs, width=width, seed=seed, text=text, doc_id=doc_id))
    nodes, seen = stable_measured(
        signed.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), n=F.count(F.lit(1))
    )
    linked = components(links(nodes.select("fingerprint"), seen["n"], bits=bits, shard=shard, block=block))
    known = linked.join(nodes.withColumnRenamed("fingerprint", "node"), "node")
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_linked = known.join(least, "root").select(F.col("node").alias("fingerprint"), "component_id")
    alone = nodes.join(of_linked, "fingerprint", "left_anti").select("fingerprint", F.col("rep").alias("component_id"))
    # Shuffled and merged: many documents of one fingerprint are split, whatever their number.
    classes = stable(of_linked.unionByName(alone)).hint("merge")
    return signed.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def links(nodes: DataFrame, n: int, *, bits: int = 4, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect what all links of the distinct ``nodes(fingerprint)``, about ``n``, connect."""
    masks = group_masks(bits)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for tree, mask in enumerate(masks):
                at, node, home = visits(points, mask, bits // len(masks), depth, tree)
                columns = [pa.array(node), pa.array(points[at].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "point", "home"])

    placed = stable(nodes.mapInArrow(place, "shard bigint, point bigint, home boolean"))
    # Shards beyond the bound are cut into blocks; those that live there meet every block.
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("n_blocks", F.ceil(F.col("rows") / block))
    own = F.pmod(F.xxhash64("point"), F.col("n_blocks"))
    dealt = placed.join(sizes.hint("merge"), "shard").withColumn("own", own)
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)
    living = dealt.where("home").select(
        "shard", "point", F.lit(True).alias("home"), F.col("own").alias("i"), F.explode(everywhere).alias("j")
    )
    visiting = dealt.where("n_blocks > 1 or not home").select(
        "shard", "point", F.lit(False).alias("home"), F.explode(everywhere).alias("i"), F.col("own").alias("j")
    )

    def compare(unit: pa.Table) -> pa.Table:
        points = unit["point"].to_numpy().view(np.uint64)
        home = unit["home"].to_numpy(zero_copy_only=False)
        a, b = forest(points[home], points, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    units = living.unionByName(visiting).groupBy("shard", "i", "j")
    found = stable(units.applyInArrow(compare, "a bigint, b bigint"))
    drop_table(placed)
    return found


def group_masks(bits: int) -> list[np.uint64]:
    """Disjoint groups of the 64 bits, more than half as many as ``bits``, of nearly equal size."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def visits(
    points: np.ndarray, mask: np.uint64, reach: int, depth: int, tree: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descend to ``depth``: index of the point, shard, and whether the point lives there.

    Vantage points follow from tree and node alone, radii are the middle of the group's distances, so that no
    index has to be fitted or sent.
    """
    radius = int(mask).bit_count() // 2
    at = np.arange(len(points))
    node = np.full(len(points), 1, np.int64)
    home = np.ones(len(points), bool)
    for _ in range(depth):
        vantage = mix((node.astype(np.uint64) << np.uint64(8)) + np.uint64(tree + 1))
        distance = np.bitwise_count((points[at] ^ vantage) & mask).astype(np.int64)
        inside = distance <= radius
        looks_in, looks_out = distance <= radius + reach, distance > radius - reach
        at = np.concatenate([at[looks_in], at[looks_out]])
        home = np.concatenate([(home & inside)[looks_in], (home & ~inside)[looks_out]])
        node = np.concatenate([2 * node[looks_in], 2 * node[looks_out] + 1])
    return at, (node << 8) + tree, home


def forest(living: np.ndarray, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from points to one point each, which connect all that pairs of ``living`` with ``points``, at
    ``bits`` differences or less, connect."""
    everything = np.unique(np.concatenate([living, points]))
    living = np.unique(living)
    own = np.searchsorted(everything, living)
    parent = np.arange(len(everything))
    step = max(1, PAIRS_AT_ONCE // max(len(everything), 1))
    for i in range(0, len(living), step):
        near = np.bitwise_count(living[i : i + step, None] ^ everything) <= bits
        a, b = np.nonzero(near)
        _unite(parent, own[i + a], b)
    root = _roots(parent, np.arange(len(everything)))
    moved = root != np.arange(len(everything))
    return everything[moved], everything[root[moved]]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        further = parent[root]
        if (further == root).all():
            return root
        root = further


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b``, pair by pair; a parent is never larger than its child."""
    while True:
        apart = a != b
        a, b = _roots(parent, a[apart]), _roots(parent, b[apart])
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Fingerprint of every stretch of bytes."""
    n_rows = len(offsets) - 1
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]]))
    # Words in lower case, one blank in front of each.
    ends = np.cumsum(solid) + np.cumsum(starts)
    spaced = np.full(int(ends[-1]) if len(data) else 0, 32, np.uint8)
    spaced[ends[solid] - 1] = _LOWER[data[solid]]
    word = ends[starts] - 1
    word_end = np.append(word[1:] - 1, len(spaced)) if len(word) else word
    in_row = np.searchsorted(np.flatnonzero(starts), offsets)
    text, digest = memoryview(spaced.tobytes()), xxhash.xxh64_intdigest
    set_bits = np.zeros((n_rows, 64), np.int64)
    n_words = np.diff(in_row)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(n_rows), n_shingles)
    begin = in_row[row] + np.arange(len(row)) - (np.cumsum(n_shingles) - n_shingles)[row]
    end = np.minimum(begin + width, in_row[row + 1]) - 1
    for i in range(0, len(row), SHINGLES_AT_ONCE):
        part = slice(i, i + SHINGLES_AT_ONCE)
        spans = zip(word[begin[part]].tolist(), word_end[end[part]].tolist())
        hashes = np.array([digest(text[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[part]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        set_bits[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = (2 * set_bits > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
