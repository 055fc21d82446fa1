"""Near-duplicate paragraphs removed across and within documents.

Paragraphs are lines with enough words. Equal shingle sets are one class. The
number of bands of MinHash values is tuned to the recall wanted at the threshold, with
as many rows as still reach it; colliding paragraphs are compared exactly, and of each
connected group the first paragraph stays.

In what stays, every run of ``PASSAGE`` words that stands word for word at an earlier place is cut too, wherever lines
begin and end. Of each such run the 32 words of smallest hash are the anchor, so that equal runs share it; only runs
whose anchor occurs twice are compared, by a hash of all their words. Tables are dropped as soon as nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tightknit.llm import similar_sets
from tightknit.llm.batches import bytes_of, id_text, offsets_of, pieces, small_batches
from tightknit.llm.components import components
from tightknit.llm.shingles import labels, mix, recall, set_ids, shingle_sets, words
from tightknit.plans.stable import drop_table, stable

THRESHOLD, MIN_WORDS = 0.8, 30
VALUES, TARGET_RECALL = 56, 0.999
#: Words of a run that is cut wherever it stands, and of its anchor: any length finds the same runs. A longer one has more
#: places in a text, but fewer edited copies share it, whose runs would all be listed only to be found unequal.
PASSAGE, ANCHOR = 50, 32
#: An odd number and its inverse among 64-bit numbers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BIN = 2048
#: Bytes of text handled at once, of which numbers take some ten times as many.
PIECE = 2 << 20
REMOVED = "removed"


def tuned_bands(values: int, threshold: float, target: float) -> tuple[int, int]:
    """Bands and rows of at most ``values`` MinHash values: most rows, then fewest bands, that reach the target."""
    for rows in range(values, 0, -1):
        for bands in range(1, values // rows + 1):
            if recall(threshold, bands, rows) >= target:
                return bands, rows
    raise ValueError(f"{values} values cannot reach a recall of {target} at similarity {threshold}")


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (line feed included) and row of every line."""
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, end = cuts[:-1], cuts[1:]
    real = end > begin
    begin, end = begin[real], end[real]
    row = np.searchsorted(offsets, begin, side="right") - 1
    return begin, end, row


def _long_paragraphs(column: pa.Array, min_words: int):
    """Row, start within the row's bytes, end, shingles and their offsets of paragraphs that count."""
    data, offsets = bytes_of(column), offsets_of(column)
    starts, _, hashes, _ = words(data, offsets)
    begin, end, row = paragraphs(data, offsets)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    long = last - first >= min_words
    begin, end, row, first, last = begin[long], end[long], row[long], first[long], last[long]
    # Words of short lines in between are left out of the stretches.
    keep = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(keep, first, 1)
    np.add.at(keep, last, -1)
    kept = hashes[np.cumsum(keep)[:-1] > 0]
    values, ends = shingle_sets(kept, np.concatenate([[0], np.cumsum(last - first)]))
    return row, begin - offsets[row], end - offsets[row], last - first, values, ends


def repeated_paragraphs(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    values: int = VALUES,
    target: float = TARGET_RECALL,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Paragraphs to remove: ``doc_id, version, start, stop, n_words, first_doc_id``.

    ``start`` and ``stop`` are bytes of the text in UTF-8, line feed included. Paragraphs of fewer than
    ``min_words`` words are left alone. Of paragraphs connected by Jaccard similarity at ``threshold`` the
    first by (doc_id, version, start) stays; ``first_doc_id`` is its document. Rows without an id take no part.
    Rows that repeat an id and a text count as one document.
    """
    bands, width = tuned_bands(values, threshold, target)
    rows = id_text(docs, F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"), text=text, doc_id=doc_id)
    rows = rows.where("doc_id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, n_bytes=PIECE):
            row, start, stop, n, sets, ends = _long_paragraphs(piece.column(1), min_words)
            if not len(row):
                continue
            marks = labels(sets, ends, bands, width)
            lists = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * bands, pa.array(marks.ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(row)), piece.column(2).take(pa.array(row)), pa.array(start.astype(np.int32)),
                 pa.array(stop.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(set_ids(sets, ends)), lists],
                ["doc_id", "version", "start", "stop", "n_words", "sid", "labels"],
            )

    signed = stable(
        rows.mapInArrow(
            sign, "doc_id bigint, version bigint, start int, stop int, n_words int, sid bigint, labels array<bigint>"
        )
    )
    place = F.struct("doc_id", "version", "start", "stop")
    lines = stable(signed.drop("labels"))
    labelled = stable(
        signed.groupBy("sid").agg(
            F.count(F.lit(1)).alias("weight"), F.min(place).alias("place"), F.first("labels").alias("labels")
        )
    )
    drop_table(signed)
    sets = stable(labelled.drop("labels"))
    met = components(similar_sets.candidate_edges(labelled))
    drop_table(labelled)
    chosen = stable(similar_sets.placed(met).join(sets, "sid"))
    n_bins = max(1, chosen.count() // BIN)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "component", "block", "n_blocks", "weight"]
        for piece in pieces(batches, n_bytes=PIECE):
            _, _, _, _, sets, ends = _long_paragraphs(piece.column(1), 1)
            items = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*piece.columns[2:], items], [*names, "items"])

    stretch = F.expr("cast(substring(cast(text as binary), place.start + 1, place.stop - place.start) as string)")
    # Texts are shuffled to their paragraphs and cuts at every size: a broadcast would end where these outgrow it.
    wanted = rows.join(
        chosen.hint("merge"), (rows["doc_id"] == chosen["place.doc_id"]) & (rows["version"] == chosen["place.version"])
    ).select(rows["doc_id"], stretch.alias("text"), "sid", "component", "block", "n_blocks", "weight")
    shape = "sid bigint, component bigint, block int, n_blocks int, weight bigint, items array<bigint>"
    links = stable(similar_sets.linked(wanted.mapInArrow(measure, shape), threshold, n_bins))
    classes = components(links.select(F.col("sid").alias("a"), F.col("other").alias("b")))
    firsts = (
        classes.join(sets.select(F.col("sid").alias("node"), "place"), "node")
        .groupBy("root")
        .agg(F.min("place").alias("class_first"))
    )
    of_set = (
        sets.join(classes.join(firsts, "root").select(F.col("node").alias("sid"), "class_first"), "sid", "left")
        .where("weight > 1 or class_first is not null")
        .select("sid", F.coalesce("class_first", "place").alias("first"))
    )
    return (
        lines.join(of_set, "sid")
        .where(place != F.col("first"))
        .select("doc_id", "version", "start", "stop", "n_words", F.col("first.doc_id").alias("first_doc_id"))
        .distinct()
    )


def _runs(column: pa.Array, size: int):
    """Runs of ``size`` words of one text: first word and row, anchor's place and hash, hash of all words; starts, stops and numbers of words.

    A word's stop takes in what follows up to a blank, one space included, but no word.
    """
    data, offsets = bytes_of(column), offsets_of(column)
    starts, ends, hashes, rows = words(data, offsets)
    stops = np.minimum(np.append(starts[1:], len(data)), offsets[rows + 1])
    blanks = np.append(np.flatnonzero(data <= 32), len(data))
    blank = blanks[np.searchsorted(blanks, ends)]
    spaced = np.append(data, 0)[blank] == 32
    stops = np.minimum(stops, blank + spaced)
    n = max(len(hashes) - size + 1, 0)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :]) if n else np.zeros(0, np.int64)
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
    places = starts - offsets[rows], stops - offsets[rows], number
    if not len(first):
        return first, first, first, np.zeros(0, np.uint64), np.zeros(0, np.uint64), *places
    up = np.cumprod(np.full(len(hashes), _BASE, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(len(hashes), _INVERSE, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    small = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(hashes) - ANCHOR + 1])
    whole = mix((sums[size:] - sums[:-size]) * down[:n])
    least = np.lib.stride_tricks.sliding_window_view(small, size - ANCHOR + 1)
    anchor = np.concatenate([first[a : a + 100_000] + least[first[a : a + 100_000]].argmin(axis=1) for a in range(0, len(first), 100_000)])
    return first, rows[first], anchor, small[anchor], whole[first], *places


def repeated_passages(
    docs: DataFrame, lines: DataFrame, *, size: int = PASSAGE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Stretches to remove besides ``lines``, with the columns of ``repeated_paragraphs``.

    A run of ``size`` words that touches no stretch of ``lines`` is repeated if an equal run stands at an
    earlier place by (doc_id, version, start), in one document without overlap. Runs that overlap or follow each other
    are one stretch; ``first_doc_id`` is where the first of them stands. So each word cut still stands in such a run of
    an earlier place. Rows without an id take no part; rows that repeat an id and a text count as one document.
    """
    rows = id_text(docs, F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"), text=text, doc_id=doc_id)
    rows = rows.where("doc_id is not null")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, n_bytes=PIECE):
            _, row, anchor, small, *_ = _runs(piece.column(1), size)
            _, once = np.unique(anchor, return_index=True)
            row, small = row[once], small[once]
            order = np.lexsort((small, row))
            row, small = row[order], small[order]
            fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (small[1:] != small[:-1])])[: len(row)])
            times = np.diff(np.append(fresh, len(row)))
            row = pa.array(row[fresh])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(row), piece.column(2).take(row), pa.array(small[fresh].view(np.int64)), pa.array(times.astype(np.int32))],
                ["doc_id", "version", "anchor", "times"],
            )

    marks = stable(rows.mapInArrow(mark, "doc_id bigint, version bigint, anchor bigint, times int"))
    twice = marks.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    # A document's own anchors and lines: as many as its text has.
    asked = marks.join(twice, "anchor").groupBy("doc_id", "version").agg(F.collect_set("anchor").alias("anchors"))
    gone = lines.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("gone"))
    asked = asked.join(gone, ["doc_id", "version"], "left").select(
        F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"), "anchors",
        F.coalesce(F.col("gone.start"), F.array().cast("array<int>")).alias("begin"),
        F.coalesce(F.col("gone.stop"), F.array().cast("array<int>")).alias("end"),
    )
    wanted = rows.join(
        asked.hint("merge"), (rows["doc_id"] == F.col("own_id")) & (rows["version"] == F.col("own_version"))
    ).select("doc_id", "text", "version", "anchors", "begin", "end")

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, n_bytes=PIECE):
            first, row, _, small, whole, starts, stops, number = _runs(piece.column(1), size)
            cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
            keep = np.zeros(len(first), bool)
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                own = np.isin(small[a:b], np.array(piece.column(3)[i].as_py(), np.int64).view(np.uint64))
                begin, end = (np.array(piece.column(c)[i].as_py(), np.int64) for c in (4, 5))
                # Lines are apart and in order: one touches a run if one that ends behind its start begins before its last word.
                behind = np.searchsorted(end, starts[first[a:b]], side="right")
                keep[a:b] = own & (np.append(begin, 1 << 40)[behind] > starts[first[a:b] + size - 1])
            first, row, whole = first[keep], row[keep], whole[keep]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole.view(np.int64)), piece.column(0).take(taken), piece.column(2).take(taken),
                 pa.array(number[first].astype(np.int32)), pa.array(starts[first].astype(np.int32)), pa.array(stops[first + size - 1].astype(np.int32))],
                ["run", "doc_id", "version", "at", "start", "stop"],
            )

    runs = stable(wanted.mapInArrow(list_runs, "run bigint, doc_id bigint, version bigint, at int, start int, stop int"))
    drop_table(marks)
    # Stored, so that both sides of the join are plain shuffles, of which a common run's can be split.
    firsts = stable(
        runs.groupBy("run")
        .agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    ).hint("merge")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    repeats = runs.join(firsts, "run").where(~same | (F.col("at") - F.col("first.at") >= size))
    own = Window.partitionBy("doc_id", "version").orderBy("at", "start")
    new = F.coalesce((F.col("at") - F.lag("at").over(own) > size).cast("int"), F.lit(0))
    return (
        repeats.withColumn("new", new)
        .withColumn("stretch", F.sum("new").over(own))
        .groupBy("doc_id", "version", "stretch")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            (F.max("at") - F.min("at") + size).alias("n_words"), F.min_by("first.doc_id", "at").alias("first_doc_id"),
        )
        .drop("stretch")
    )


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all its columns, the text cut, and ``removed``: the paragraphs cut from it.

    ``removed`` is an array of ``(start, stop, n_words, first_doc_id)`` in order, empty where nothing was
    cut; such texts, null ones too, are unchanged.
    """
    return _without(docs, repeated_paragraphs(docs, text=text, doc_id=doc_id, **options), text, doc_id)


def without_repeated_text(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """As ``without_repeats``, with the repeated passages of what stays cut too."""
    lines = stable(repeated_paragraphs(docs, text=text, doc_id=doc_id, **options))
    passages = repeated_passages(docs, lines, text=text, doc_id=doc_id)
    return _without(docs, lines.unionByName(passages), text, doc_id)


def _without(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    small_batches(docs)
    # A document's own paragraphs: as many as its text has.
    cuts = found.groupBy(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "n_words", "first_doc_id"))).alias("removed")
    )
    version = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    own = (docs[doc_id].cast("bigint") == cuts["cut_id"]) & (version == cuts["cut_version"])
    none = F.array().cast("array<struct<start:int,stop:int,n_words:int,first_doc_id:bigint>>")
    joined = docs.join(cuts.hint("merge"), own, "left").select(
        *(docs[c] for c in docs.columns), F.coalesce(cuts["removed"], none).alias(REMOVED)
    )
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
            lengths = lists.value_lengths().to_pylist()
            for i in (i for i, n in enumerate(lengths) if n):
                data, kept, done = texts[i].encode(), [], 0
                for stretch in lists[i].as_py():
                    kept.append(data[done : stretch["start"]])
                    done = stretch["stop"]
                texts[i] = b"".join([*kept, data[done:]]).decode()
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return joined.mapInArrow(cut, joined.schema)
