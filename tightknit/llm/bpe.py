"""Byte-level BPE encoding and decoding through a table of distinct words.

Spark splits texts into words. A task keeps consecutive texts as a chunk: its distinct words, and for each
text the numbers of its words in order. The distinct words go to the task of their hash; there every
distinct word is encoded once for all chunks that have it, and its ids go back to these chunks,
where they are joined to the words by position. Decoding joins ids to the pieces they stand for.

Chunks are shuffled once, compressed, for both steps that read them; beside them only lists of
distinct words and of their ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer

from tightknit.llm.batches import bytes_of, offsets_of, small_batches

# Fixed value: the split of byte-level BPE. (?U): white space as Unicode has it.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text after which a chunk is full; a longer text is in one chunk too.
CHUNK = 10 << 20
#: Words of a chunk whose ids are put together at once.
SLICE = 200_000


def byte_letters() -> dict[int, str]:
    """Letters of byte-level vocabularies by byte: visible Latin-1 is itself, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}


def packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(x.tobytes() for x in arrays))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        found.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return found


def packed_words(words: pa.Array) -> bytes:
    return packed(np.diff(offsets_of(words)).astype(np.uint32), bytes_of(words))


def unpacked_words(data: bytes) -> pa.Array:
    lengths, values = unpacked(data, "<u4", "u1")
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of stretches given by start and length, one stretch after the other."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)


def encoder(tokenizer: Tokenizer):
    """``words as bytes -> number of ids of each, all ids``, as the library encodes each word alone."""
    table, merge = str.maketrans({chr(b): c for b, c in byte_letters().items()}), tokenizer.model.tokenize

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(words)
        whole = []
        for i, word in enumerate(words):
            # A word of plain ASCII is one pre-token; others may be texts that were not split.
            if word.isascii() and b"<|" not in word:
                found[i] = [t.id for t in merge(word.decode().translate(table))]
            else:
                whole.append(i)
        for start in range(0, len(whole), 10_000):
            part = whole[start : start + 10_000]
            codes = tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)
            for i, code in zip(part, codes):
                found[i] = code.ids
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32)

    return encode


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as the tokenizers library gives them.

    ``vocabulary`` is a byte-level BPE file of that library, read by the driver and sent along. Strings of special
    tokens become those tokens, as by the library's default; such texts, and texts with code points that
    this Java does not know, are encoded as one word. A null or empty text has no ids.
    One row per row of ``docs``, repeated ids too.
    """
    small_batches(docs)
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
    shared = spark.sparkContext.broadcast(spec)
    whole = F.col("text").rlike(r"\p{Cn}")
    for special in specials:
        whole = whole | F.col("text").contains(special)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // CHUNK))
    split = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    none = F.array().cast("array<string>")
    worded = rows.select("doc_id", F.when(F.col("text") == "", none).otherwise(split).alias("words"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive texts as numbers of their distinct words, these in the order of their buckets."""
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        words: list[pa.Array] = []

        def full() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            words.clear()
            distinct = coded.dictionary
            bucket = np.array([zlib.crc32(w) % n for w in distinct.to_pylist()], np.int64)
            order = np.lexsort((pc.rank(distinct).to_numpy(), bucket))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            numbers = place[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.uint32)
            del coded, place
            doc_ids = pa.concat_arrays(ids)
            texts = packed(
                doc_ids.is_valid().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy(), np.concatenate(counts), numbers
            )
            listed = packed_words(distinct.take(pa.array(order)))
            # Named by what it holds, so that a repeated task gives the same name.
            name = int.from_bytes(hashlib.blake2b(texts + listed, digest_size=8).digest(), "little", signed=True)
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([texts], pa.binary()), pa.array([listed], pa.binary())],
                ["chunk", "texts", "words"],
            )

        size = 0
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                own = part.column(1).flatten().cast(pa.large_binary())
                ids.append(part.column(0))
                counts.append(part.column(1).value_lengths().to_numpy().astype(np.int32))
                words.append(own)
                size += int(offsets_of(own)[-1])
                if size >= CHUNK:
                    yield full()
                    ids, counts, words, size = [], [], [], 0
        if ids:
            yield full()

    def buckets(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        keys = np.array([zlib.crc32(w) % n for w in words.to_pylist()], np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        yield from ((int(keys[a]), words.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each chunk, by their bucket."""
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                parts = [(key, packed_words(part)) for key, part in buckets(unpacked_words(listed))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in parts], pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())],
                    ["bucket", "chunk", "words"],
                )

    def answer(table: pa.Table) -> pa.Table:
        """Each distinct word of a bucket encoded once, for every chunk that asked."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        asked = [unpacked_words(x) for x in table.column("words").to_pylist()]
        coded = pa.concat_arrays(asked).dictionary_encode()
        size, flat = encoder(Tokenizer.from_str(shared.value))(coded.dictionary.to_pylist())
        start, numbers = np.cumsum(size) - size, coded.indices.to_numpy()
        ids, done = [], 0
        for words in asked:
            own = numbers[done : done + len(words)]
            ids.append(packed(size[own].astype(np.uint32), flat[_stretches(start[own], size[own])]))
            done += len(words)
        return table.select(["bucket", "chunk"]).append_column("ids", pa.array(ids, pa.binary()))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids for every word of the chunk's texts, in the words' places."""
        # A chunk's words are in the order of the buckets, and so are the answers.
        _, first = np.unique(right.column("bucket").to_numpy(), return_index=True)  # equal chunks ask twice
        right = right.take(first)
        parts = [unpacked(x, "<u4", "<u4") for x in right.column("ids").to_pylist()]
        size = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([x for _, x in parts] or [np.zeros(0, np.uint32)])
        start = np.cumsum(size) - size
        tables = []
        for x in left.column("texts").to_pylist():  # several only if chunks are equal
            valid, doc_ids, counts, numbers = unpacked(x, "?", "<i8", "<i4", "<u4")
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            row = 0
            while row < len(counts):
                stop = max(int(np.searchsorted(ends, ends[row] + SLICE, side="right")) - 1, row + 1)
                own = numbers[ends[row] : ends[stop]]
                length = size[own]
                total = np.concatenate([[0], np.cumsum(length)])
                ids = flat[_stretches(start[own], length)].astype(np.int32)
                lists = pa.ListArray.from_arrays(total[ends[row : stop + 1] - ends[row]].astype(np.int32), pa.array(ids))
                tables.append(pa.table([pa.array(doc_ids[row:stop], mask=~valid[row:stop]), lists], names=["doc_id", "ids"]))
                row = stop
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(tables) if tables else empty

    chunks = worded.mapInArrow(chunk, "chunk bigint, texts binary, words binary").repartition(n, "chunk")
    answered = (
        chunks.mapInArrow(ask, "bucket int, chunk bigint, words binary")
        .groupBy("bucket")
        .applyInArrow(answer, "bucket int, chunk bigint, ids binary")
    )
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(join, "doc_id bigint, ids array<int>")


def piece_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces in the order of their ids, and their offsets; as large as the vocabulary."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    back = {c: b for b, c in byte_letters().items()}
    pieces = {i: bytes(back[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return np.frombuffer(b"".join(ordered), np.uint8), np.cumsum([0, *map(len, ordered)])


def _joined(pieces: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of the ids in column ``at`` as a column ``decoded``."""
    values, offsets = pieces
    size = np.diff(offsets)
    for whole in batches:
        for row in range(0, whole.num_rows, 200):
            batch = whole.slice(row, 200)
            column = pc.fill_null(batch.column(at), pa.scalar([], batch.schema.field(at).type))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            codes = column.flatten().to_numpy()
            length = size[codes]
            total = np.concatenate([[0], np.cumsum(length)])
            cells = values[_stretches(offsets[codes], length)].tobytes()
            edges = total[ends]
            texts = [cells[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids, special tokens included.

    Ids are joined to the table of pieces, which is no larger than the vocabulary and goes to every task.
    Bytes that are no UTF-8 become U+FFFD. Null ids give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(vocabulary))
    at = encoded.columns.index(ids)
    shape = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(lambda batches: _joined(shared.value, batches, at), shape)


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``doc_id, ids`` and the texts these are decoded to.

    Decoding and digesting share a Python worker.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(vocabulary))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(shared.value, batches, 1):
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            shas = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
            texts, offsets = bytes_of(batch.column(2)), offsets_of(batch.column(2))
            read = [hashlib.sha256(texts[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(shas, pa.string()), pa.array(read, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    shape = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "ids").mapInArrow(digest, shape)
