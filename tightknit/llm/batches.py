"""Arrow batches of texts as numpy arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text handled at once inside a task; a longer text is handled alone.
PIECE_BYTES = 4 << 20


#: Rows sent to Python at once, which are whole texts.
BATCH_ROWS = 1_000


def small_batches(docs: DataFrame) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``.

    Ten thousand texts, Spark's default, are tens of MB that the JVM and Python hold at the same time in every task.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def id_text(docs: DataFrame, *more: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Id and whole text (null: empty) of every row, without the other columns, for use in Python."""
    small_batches(docs)
    return docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), *more
    )


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", n_bytes: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches again, sliced so that each slice holds about ``n_bytes`` of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.diff(offsets_of(column)))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + n_bytes, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Offsets into ``bytes_of(column)``, one more than there are rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64) - int(offsets[0])


def bytes_of(column: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of all rows of a string column, one after the other."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[-1])]


def row_of_byte(offsets: np.ndarray) -> np.ndarray:
    """For every byte the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's stretch, empty stretches included."""
    totals = np.concatenate([[0], np.cumsum(values)])
    return totals[offsets[1:]] - totals[offsets[:-1]]
