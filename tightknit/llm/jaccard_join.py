"""N-gram Jaccard self-join of documents by a MinHash LSH forest.

Candidates are the sets that meet below a node of the forest (``lsh_forest``), first of its whole paths. All
candidates are compared exactly, and the prefixes are then shortened to the longest ones at which the weakest link seen
meets with the target recall, until no link seen is weaker than that. So the depth follows from the data, between ``depth``
and the depth that suffices for links right at the threshold, and each link seen was found by prefixes that
miss at most one in 1 / (1 - target) of its kind. Links weaker than all that were seen can remain unseen only if each of
them misses the longer prefixes too: with 40 trees of 10 values, k links right at the threshold do so with a
chance of 0.011^k, so that stopping early loses 0.011 links of a corpus on average at worst.

Documents with equal sets are one class, compared once. Candidates' components
are compared in blocks (``similar_sets``), so that pairs are counted but never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.llm import lsh_forest, similar_sets
from tightknit.llm.batches import bytes_of, id_text, offsets_of, pieces
from tightknit.llm.components import components
from tightknit.llm.lsh_forest import stop_depth
from tightknit.llm.shingles import set_ids, shingle_sets, words
from tightknit.plans.stable import drop_table, stable

THRESHOLD = 0.8
TREES, DEPTH = 40, 10
TARGET_RECALL = 0.9999

#: Small candidate components compared by one task call hold about so many sets.
BIN = 512
#: Bytes of text handled at once, of which numbers take some ten times as many.
PIECE = 1 << 20


def _sets(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text and their offsets."""
    column = piece.column(piece.schema.get_field_index("text"))
    offsets = offsets_of(column)
    _, _, hashes, rows = words(bytes_of(column), offsets)
    return shingle_sets(hashes, np.searchsorted(rows, np.arange(len(offsets))))


def jaccard_classes(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target: float = TARGET_RECALL,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Class and links of every document: ``doc_id, version, class_id, n_links``.

    ``n_links`` counts the other rows of ``docs`` whose five-word shingle set has Jaccard similarity
    ``threshold`` or more, exact copies included. ``class_id`` is the smallest id of the rows connected
    by links. Texts of one to four words are one shingle; texts without words, null and
    empty ones, are linked to nothing and are classes of their own, as are rows without an id
    (class null). Rows that repeat an id are rows of their own. ``version`` is a hash of the text.
    """
    floor = stop_depth(trees, depth, threshold, target)
    rows = id_text(docs, F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"), text=text, doc_id=doc_id)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, n_bytes=PIECE):
            values, offsets = _sets(piece)
            full = np.diff(offsets) > 0
            marks = np.zeros((len(full), trees * depth), np.uint8)
            if full.any():
                marks[full] = lsh_forest.paths(values, np.append(offsets[:-1][full], offsets[-1]), trees, depth)
            marks = pa.array([row.tobytes() for row in marks], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(set_ids(values, offsets)), pa.array(full), marks],
                ["doc_id", "version", "sid", "full", "paths"],
            )

    signed = stable(
        rows.mapInArrow(sign, "doc_id bigint, version bigint, sid bigint, full boolean, paths binary")
    )
    usable = signed.where("full and doc_id is not null")
    sets = stable(
        usable.groupBy("sid").agg(
            F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("rep"), F.first("paths").alias("paths")
        )
    )
    slim = stable(signed.drop("paths"))
    drop_table(signed)
    joints = lsh_forest.joints(sets.select("sid", "paths"), trees, depth, floor)
    known = stable(sets.drop("paths"))
    drop_table(sets)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, n_bytes=PIECE):
            values, offsets = _sets(piece)
            same = set_ids(values, offsets) == piece.column(2).to_numpy()  # a repeated id has other texts too
            items = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values.view(np.int64)))
            names = ["sid", "component", "block", "n_blocks", "weight"]
            yield pa.RecordBatch.from_arrays([*piece.columns[2:], items], [*names, "items"]).filter(pa.array(same))

    def links_at(d: int) -> DataFrame:
        """Links of the sets that meet at prefixes of ``d`` values."""
        met = components(joints.where(F.col("agree") >= d))
        chosen = stable(similar_sets.placed(met).join(known, "sid"))
        n_bins = max(1, chosen.count() // BIN)
        # Shuffled at every size: a broadcast would end where the candidates outgrow it.
        wanted = rows.select("doc_id", "text").join(chosen.hint("merge"), F.col("doc_id") == F.col("rep")).select(
            "doc_id", "text", "sid", "component", "block", "n_blocks", "weight"
        )
        shape = "sid bigint, component bigint, block int, n_blocks int, weight bigint, items array<bigint>"
        found = stable(similar_sets.linked(wanted.mapInArrow(measure, shape), threshold, n_bins))
        drop_table(chosen)
        drop_table(met)
        return found

    now = depth
    while True:
        links = links_at(now)
        weakest = links.agg(F.min("weakest")).first()[0]
        enough = now if weakest is None else stop_depth(trees, now, max(weakest, threshold), target)
        if enough == now:
            break
        drop_table(links)
        now = enough
    drop_table(joints)

    classes = components(links.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    near = links.groupBy("sid").agg(F.sum("n_linked").alias("near"))
    firsts = (
        classes.join(known.select(F.col("sid").alias("node"), "rep"), "node")
        .groupBy("root")
        .agg(F.min("rep").alias("class_rep"))
    )
    of_set = (
        known.join(near, "sid", "left")
        .join(classes.join(firsts, "root").select(F.col("node").alias("sid"), "class_rep"), "sid", "left")
        .select(
            "sid",
            F.coalesce("class_rep", "rep").alias("class_id"),
            (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
        )
    )
    alone = slim.where("not full or doc_id is null").select(
        "doc_id", "version", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return (
        slim.where("full and doc_id is not null")
        .select("doc_id", "version", "sid")
        .join(of_set, "sid")
        .select("doc_id", "version", "class_id", "n_links")
        .unionByName(alone)
    )


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with their columns; rows without an id stay.

    Of rows that repeat that id with the same text all but one go.
    """
    classes = jaccard_classes(docs, text=text, doc_id=doc_id, **options)
    gone = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct()
    version = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    gone = gone.hint("merge")
    kept = docs.join(gone, (docs[doc_id].cast("bigint") == gone["gone_id"]) & (version == gone["gone_version"]), "left_anti")
    repeated = (
        classes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    if repeated.isEmpty():
        return kept
    twice = kept.join(repeated.select(F.col("doc_id").alias("again")), kept[doc_id].cast("bigint") == F.col("again"), "left_semi")
    once = kept.join(repeated.select(F.col("doc_id").alias("again")), kept[doc_id].cast("bigint") == F.col("again"), "left_anti")
    return once.unionByName(twice.dropDuplicates([doc_id, text]))
