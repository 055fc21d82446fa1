"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ``ORDER`` counts what follows each of them in all training texts. A symbol is coded in
the longest context known; if it is not among what followed there, an escape is coded, and the next shorter context is
asked, without the symbols already excluded. An escape gets half a count of each symbol. A text's score is its code
length, end included, as a log10 probability.

Counts come from all training texts, and none is cut. Each chunk of texts, large so that few codes travel twice, asks for its distinct codes, a symbol with all of
its context, at buckets of their last ``GLOBAL`` + 1 context symbols; there all counts of these contexts and of the longer ones
meet, the bucket builds their part of the trie and answers the chunk, with the codes. Only the orders up to ``GLOBAL``, which the
alphabet bounds, go to every task. As what follows a context also follows its shorter ones, one pass of lookups per
order gives every score.

The base score is a unigram of words. Words that make up ``WORD_SHARE`` of all, at most
``1 / WORD_SHARE`` by proof, go to every task; the others are joined, and none of them is hot.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, crc_of_id, offsets_of, pieces, small_batches
from tightknit.llm.bpe import packed, packed_words, unpacked, unpacked_words
from tightknit.llm.shingles import mix
from tightknit.plans.stable import drop_table, stable

ORDER = 6
#: Longest contexts that go to every task.
GLOBAL = 2
WORD_SHARE = 1e-6

#: Symbols: 0 stands before a text, 1 to 256 are bytes, 257 is a text's end.
BITS, END, SYMBOLS = 9, 257, 257
EMPTY = np.uint64(2**64 - 1)
#: Words that a task sums before it sends them; codes that a bucket holds before it sums them; codes of one run that are merged at once.
HELD_WORDS, HELD_CODES, MERGED_CODES = 300_000, 3_000_000, 200_000
#: Bytes of texts that ask together, in pieces; a longer text asks alone. The more ask together, the fewer codes are asked for twice.
CHUNK_BYTES, TEXT_PIECE = 16 << 20, 1 << 19
#: Bytes of text for each bucket that counts are merged in.
BUCKET_BYTES = 8 << 20


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coded symbol with the ``ORDER`` symbols before it as one number, and the texts' offsets in these."""
    lengths = np.diff(offsets)
    n = len(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER + 1)])
    row = np.zeros(int(starts[-1]), np.uint64)
    place = np.arange(len(data)) + np.repeat(starts[:-1] + ORDER - offsets[:-1], lengths)
    row[place] = data.astype(np.uint64) + np.uint64(1)
    row[starts[1:] - 1] = END
    code = np.zeros(max(len(row) - ORDER, 0), np.uint64)
    for t in range(ORDER + 1):
        code = code << np.uint64(BITS) | row[t : len(row) - ORDER + t]
    keep = np.ones(len(code), bool)
    inner = starts[1:-1]
    for t in range(ORDER):  # those that would code the padding of the next text
        keep[inner - ORDER + t] = False
    return code[keep], np.concatenate([[0], np.cumsum(lengths + 1)]) if n else np.zeros(1, np.int64)


class Table:
    """Open hashing of 64-bit keys: place of a key among those given, or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, EMPTY), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[left[free]]  # of several the last one stays
            won = self.keys[slot] == keys[left]
            self.at[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.at[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            found[open_[hit]] = self.at[slot[hit]]
            go = ~hit & (held != EMPTY)
            open_, slot = open_[go], slot[go]
        return found

    def parts(self) -> tuple:
        return self.keys, self.at, self.shift, self.mask

    @classmethod
    def of(cls, parts: tuple) -> "Table":
        table = cls.__new__(cls)
        table.keys, table.at, table.shift, table.mask = parts
        return table


_THREE, _SYMBOL = np.uint64((1 << 3 * BITS) - 1), np.uint64((1 << BITS) - 1)


def rotated(code: np.ndarray) -> np.ndarray:
    """The codes with their last three context symbols, of which the bucket is made, in front."""
    return (code >> np.uint64(BITS) & _THREE) << np.uint64(4 * BITS) | code >> np.uint64(4 * BITS) << np.uint64(BITS) | code & _SYMBOL


def straight(turned: np.ndarray) -> np.ndarray:
    """The codes of ``rotated``."""
    return (turned >> np.uint64(BITS) & _THREE) << np.uint64(4 * BITS) | turned >> np.uint64(4 * BITS) << np.uint64(BITS) | turned & _SYMBOL


def build(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """The trie's code lengths from codes and counts of every order, as plain arrays."""
    return lookups(orders(grams))


def lookups(levels: list[dict]) -> list[dict]:
    return [
        {"nodes": Table(v["codes"]).parts(), "places": Table(v["contexts"]).parts(),
         **{name: v[name].astype(np.float32) for name in ("fresh", "log", "down", "back")}}
        for v in levels
    ]


def orders(grams: list[tuple[np.ndarray, np.ndarray]], lower: list[dict] = ()) -> list[dict]:
    """What ``lookups`` needs of the orders above ``lower``, of which all contexts that end alike are given.

    ``grams[k]`` has k + 1 symbols each. For a node: its log count, and its log probability where its
    context is the first one asked. For a context: ``down``, the cost of escaping from it, as the first, to the
    order below any; ``back``, what of that is not due, with the size of what remains, if the order below it answers.
    """
    levels, log = list(lower), np.log10
    for k, (codes, counts) in enumerate(grams, len(lower)):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        context = codes >> np.uint64(BITS)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(codes)])
        contexts = context[first]
        different = np.diff(np.append(first, len(codes))).astype(np.float64)
        raw = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
        counts = counts - 0.5  # each symbol cedes half a count to the escape
        total, half = raw - different / 2, different / 2
        of_node = np.repeat(np.arange(len(first)), different.astype(np.int64))
        # What followed but was cut from the trie; a context's own count stands one order below.
        cut = np.zeros(len(first))
        if k and len(levels[-1]["codes"]):
            at = np.minimum(levels[-1]["codes"].searchsorted(contexts), len(levels[-1]["codes"]) - 1)
            own = levels[-1]["codes"][at] == contexts
            cut[own] = np.maximum(levels[-1]["counts"][at] + 0.5 - raw, 0)[own]
        escape = half + cut
        fresh = log(counts) - log(total + escape)[of_node]
        if k == 0:
            remaining, unseen, chain = np.full(len(first), SYMBOLS) - different, np.zeros(len(first)), np.zeros(len(first))
            size = log(np.maximum(remaining, 1))
            step = np.zeros(len(first))
        else:
            below = levels[-1]
            short = below["codes"].searchsorted(codes & np.uint64((1 << BITS * k) - 1))
            excluded = np.add.reduceat(below["counts"][short], first) if len(first) else np.zeros(0)
            parent = below["contexts"].searchsorted(contexts & np.uint64((1 << BITS * (k - 1)) - 1))
            unseen = below["escape"][parent] - half
            remaining = below["total"][parent] - excluded + unseen
            size = log(np.maximum(remaining, 1e-300))
            step = np.where(unseen > 0, log(np.maximum(unseen, 1e-300)) - size, 0.0)
            chain = below["chain"][parent]
        chain = chain + step
        down = log(escape) - log(total + escape) + chain
        levels.append(
            {"codes": codes, "counts": counts, "contexts": contexts, "escape": escape, "total": total,
             "chain": chain, "fresh": fresh, "log": log(counts), "down": down, "back": size + chain}
        )
    return levels[len(lower):]


def log_probabilities(codes: np.ndarray, levels: list[dict]) -> np.ndarray:
    """Log10 probability of each coded symbol."""
    if not len(levels[0]["fresh"]):
        return np.full(len(codes), -math.log10(SYMBOLS))
    result = np.zeros(len(codes))
    left, down, back = np.arange(len(codes)), None, None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        own = codes[left] & np.uint64((1 << BITS * (k + 1)) - 1)
        node = Table.of(level["nodes"]).find(own)
        seen = node >= 0
        value = level["fresh"][node[seen]].astype(np.float64)
        if down is not None:
            entered = ~np.isnan(down[seen])  # by an escape from a longer context
            value = np.where(entered, level["log"][node[seen]] + down[seen] - back[seen], value)
        result[left[seen]] = value
        left = left[~seen]
        place = Table.of(level["places"]).find(own[~seen] >> np.uint64(BITS))
        known = place >= 0
        down = np.full(len(left), np.nan) if down is None else down[~seen]
        first = known & np.isnan(down)
        down[first] = level["down"][place[first]]
        back = np.full(len(left), np.nan)
        back[known] = level["back"][place[known]]
    result[left] = down - back
    return result


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of each one's counts."""
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes, kind="stable")
    all_codes = all_codes[order]
    first = np.flatnonzero(np.concatenate([[True], all_codes[1:] != all_codes[:-1]])[: len(order)])
    return all_codes[first], np.add.reduceat(all_counts[order], first, dtype=all_counts.dtype) if len(first) else all_counts


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` of runs of which each is in order, range by range, so that little more than runs and result is held."""
    longest = max(codes, key=len)
    cuts = longest[MERGED_CODES::MERGED_CODES]
    bounds = [[0, *run.searchsorted(cuts).tolist(), len(run)] for run in codes]
    parts = [
        summed([run[at[i] : at[i + 1]] for run, at in zip(codes, bounds)], [n[at[i] : at[i + 1]] for n, at in zip(counts, bounds)])
        for i in range(len(cuts) + 1)
    ]
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def deduped(codes: np.ndarray) -> np.ndarray:
    """Distinct codes in order, by sorting: ``np.unique`` hashes, which takes several times as long for so many."""
    ordered = np.sort(codes)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]]


def placed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and each code's place among them."""
    order = np.argsort(codes)
    ordered = codes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
    at = np.empty(len(codes), np.int64)
    at[order] = np.cumsum(first) - 1
    return ordered[first], at


def counted(codes: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each one is not held out. Values alone are sorted, with ``out`` as their spare 64th bit."""
    ordered = codes << np.uint64(1) | out
    ordered.sort()
    training = (~ordered & np.uint64(1)).astype(np.uint32)
    ordered >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[first], np.add.reduceat(training, first, dtype=np.uint32) if len(first) else training


def looked_up(keys: np.ndarray, asked: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The log of each key, all of which are among ``asked``, in order. Keys are mixed numbers.

    They are sorted by their high bits with their places as the low ones; equal keys that others part are looked up again.
    """
    bits = np.uint64(len(keys).bit_length())
    at = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    at.sort()
    at = (at & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    ordered = keys[at]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    found = np.empty(len(keys))
    found[at] = np.repeat(logs[asked.searchsorted(ordered[first])], np.diff(np.append(first, len(keys))))
    return found


_BLANK = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of the texts, one after the other, and the texts' offsets in these."""
    word, edge = ~_BLANK[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    at = np.concatenate([[0], np.cumsum(ends - begins)])
    values = _LOWERED[data[word]]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(values)])
    return found.dictionary_encode(), begins.searchsorted(offsets)


def planes(values: np.ndarray) -> np.ndarray:
    """The values' bytes by significance, the lowest of all first: those that are alike pack well side by side."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.ravel()


def of_planes(data: np.ndarray, kind: str) -> np.ndarray:
    """The values of ``planes``."""
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    yield from ((int(bucket[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows))


def _bucket(turned: np.ndarray, n: int) -> np.ndarray:
    return (mix(turned >> np.uint64(4 * BITS)) % np.uint64(n)).astype(np.int64)


CODES, TEXTS = 0, 1


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """``kind, bucket, chunk, payload``: each chunk's texts, and its distinct codes by bucket with their counts in training texts.

    Codes that begin alike after ``rotated`` share a bucket, so that they pack well.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def batch(kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(parts), pa.int32()), pa.array([b for b, _ in parts], pa.int32()),
                 pa.array([chunk] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())],
                ["kind", "bucket", "chunk", "payload"],
            )

        def sent_chunk(texts: bytes, codes: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield batch(TEXTS, [(0, texts)])
            turned, counts = merged(codes, times)
            codes.clear(), times.clear()
            steps = (
                (b, packed(planes(np.diff(turned[rows], prepend=np.uint64(0))), planes(counts[rows])))
                for b, rows in _split(_bucket(turned, n))
            )
            yield batch(CODES, list(steps))

        sink, texts, codes, times, size = None, None, [], [], 0
        for piece in pieces(batches, n_bytes=TEXT_PIECE):
            data, offsets = bytes_of(piece.column(2)), offsets_of(piece.column(2))
            out = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
            own, ends = coded(data, offsets)
            turned, training = counted(rotated(own), np.repeat(out, np.diff(ends)))
            if texts is None:
                sink = pa.BufferOutputStream()
                texts = pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
            texts.write_batch(piece)
            codes.append(turned)
            times.append(training)
            if len(codes) > 8:
                codes, times = ([x] for x in merged(codes, times))
            size += len(data)
            if size >= CHUNK_BYTES:
                texts.close()
                yield from sent_chunk(sink.getvalue().to_pybytes(), codes, times)
                sink, texts, codes, times, size, chunk = None, None, [], [], 0, chunk + 1
        if texts is not None:
            texts.close()
            yield from sent_chunk(sink.getvalue().to_pybytes(), codes, times)

    return stable(rows.mapInArrow(send, "kind int, bucket int, chunk bigint, payload binary"))


def _unpacked_codes(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, times = unpacked(payload, "u1", "u1")
    return np.cumsum(of_planes(steps, "<u8"), dtype=np.uint64), of_planes(times, "<u4").astype(np.int64)


def _words(rows: DataFrame, n: int) -> DataFrame:
    """``word, n`` of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def summed_words() -> pa.RecordBatch:
            keys = sorted(words)
            times = np.array([words[w] for w in keys], np.int64)
            words.clear()
            parts = [
                (b, packed(planes(times[rows]), np.frombuffer(packed_words(pa.array([keys[i] for i in rows], pa.large_binary())), np.uint8)))
                for b, rows in _split(np.array([zlib.crc32(w) % n for w in keys], np.int64))
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "payload"]
            )

        for piece in pieces(batches, n_bytes=TEXT_PIECE):
            data, offsets = bytes_of(piece.column(0)), offsets_of(piece.column(0))
            found = words_of(data, offsets)[0]
            for word, times in zip(found.dictionary.to_numpy(zero_copy_only=False), np.bincount(found.indices, minlength=len(found.dictionary)).tolist()):
                words[word] += times
            if len(words) > HELD_WORDS:
                yield summed_words()
        if words:
            yield summed_words()

    def merge(table: pa.Table) -> pa.Table:
        words, times = [pa.array([], pa.large_binary())], [np.zeros(0, np.int64)]
        for payload in table.column("payload").to_pylist():
            own, listed = unpacked(payload, "u1", "u1")
            words.append(unpacked_words(listed.tobytes()))
            times.append(of_planes(own, "<i8"))
        listed = pa.concat_arrays(words).dictionary_encode()
        sums = np.bincount(listed.indices.to_numpy(), np.concatenate(times), len(listed.dictionary)).astype(np.int64)
        return pa.table([listed.dictionary.cast(pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())], names=["word", "n"])

    held = rows.where(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, payload binary")
    return stable(held.groupBy("bucket").applyInArrow(merge, "word string, n bigint"))


def _lower(sent: DataFrame) -> list[dict]:
    """The orders up to ``GLOBAL``, whole: at most as many rows as there are strings of ``GLOBAL`` + 1 symbols."""
    mask = np.uint64((1 << BITS * (GLOBAL + 1)) - 1)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for payload in batch.column(0):
                turned, times = _unpacked_codes(payload.as_py())
                own, times = summed([straight(turned[times > 0]) & mask], [times[times > 0]])
                codes.append(own)
                counts.append(times)
                if sum(map(len, codes)) > HELD_CODES:
                    codes, counts = map(list, zip(summed(codes, counts)))
        codes, counts = summed(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "n"])

    found = sent.where(F.col("kind") == CODES).select("payload").mapInArrow(ends, "code bigint, n bigint")
    kept = found.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = kept.column(0).to_numpy().astype(np.int64).view(np.uint64), kept.column(1).to_numpy().astype(np.int64)
    return orders([summed([codes & np.uint64((1 << BITS * (k + 1)) - 1)], [counts]) for k in range(GLOBAL + 1)])


def _answers(sent: DataFrame, lower: list[dict]) -> DataFrame:
    """``chunk, payload``: the codes that the chunk sent to a bucket, with their log10 probabilities."""
    shared = sent.sparkSession.sparkContext.broadcast((lower, lookups(lower)))

    def answer(table: pa.Table) -> pa.Table:
        lower, below = shared.value
        codes, counts, size = [], [], 0
        for payload in table.column("payload"):
            turned, times = _unpacked_codes(payload.as_py())
            codes.append(turned)
            counts.append(times)
            size += len(turned)
            if size > HELD_CODES:
                together, times = merged(codes, counts)
                codes, counts, size = [together], [times], 0
        asked, counts = merged(codes, counts)
        del codes
        known = straight(asked[counts > 0])
        masks = (np.uint64((1 << BITS * (k + 1)) - 1) for k in range(GLOBAL + 1, ORDER + 1))
        levels = below + lookups(orders([summed([known & m], [counts[counts > 0]]) for m in masks], lower))
        logs = np.concatenate([log_probabilities(straight(asked[a : a + 200_000]), levels) for a in range(0, len(asked), 200_000)]).astype(np.float32)
        replies = []
        for payload in table.column("payload"):
            steps = unpacked(payload.as_py(), "u1", "u1")[0]
            replies.append(packed(steps, planes(logs[asked.searchsorted(np.cumsum(of_planes(steps, "<u8"), dtype=np.uint64))])))
        return pa.table([table.column("chunk"), pa.array(replies, pa.binary())], names=["chunk", "payload"])

    held = sent.where(F.col("kind") == CODES).select("chunk", "bucket", "payload")
    return held.groupBy("bucket").applyInArrow(answer, "chunk bigint, payload binary")


def score(
    docs: DataFrame,
    held_out: Column | None = None,
    *,
    word_share: float = WORD_SHARE,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Scores of every whole text by a model of the texts that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of
    ``docs``, repeated ids too. Null texts are empty: their only token is the end. Without training
    texts every symbol is equally likely, and every token unknown.
    ``held_out`` defaults to a tenth of the ids by crc32 of the id as text.
    """
    small_batches(docs)
    out = crc_of_id(doc_id) % 10 == 0 if held_out is None else held_out
    rows = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), out.alias("held_out"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    sent = _sent(rows, n_buckets)
    words = _words(rows, n_buckets)
    answers = _answers(sent, _lower(sent))
    n_ends = rows.where(~F.col("held_out")).count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n_words + n_ends, distinct + (n_ends > 0)
    size = n + 0.1 * (v + 1)
    least = max(1, math.ceil(word_share * n))
    common = words.where(F.col("n") >= least).toArrow()  # at most 1 / word_share words
    heavy = {w.encode(): math.log10((c + 0.1) / size) for w, c in zip(common.column(0).to_pylist(), common.column(1).to_pylist())}
    end = math.log10((n_ends + 0.1) / size)
    unknown = math.log10(0.1 / size)
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def measure(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        heavy, parts, asked, logs = shared.value, [], [], []
        for payload in replies.column("payload"):
            steps, own = unpacked(payload.as_py(), "u1", "u1")
            asked.append(mix(np.cumsum(of_planes(steps, "<u8"), dtype=np.uint64)))
            logs.append(of_planes(own, "<f4"))
        asked, logs = np.concatenate(asked), np.concatenate(logs)
        order = np.argsort(asked)
        asked, logs = asked[order], logs[order]
        del order
        for payload in chunks.column("payload"):
            for piece in pa.ipc.open_stream(payload.as_buffer()):
                data, offsets = bytes_of(piece.column(2)), offsets_of(piece.column(2))
                codes, ends = coded(data, offsets)
                scores = np.add.reduceat(looked_up(mix(rotated(codes)), asked, logs), ends[:-1])
                found, begins = words_of(data, offsets)
                values = np.array([heavy.get(word, math.nan) for word in found.dictionary.to_numpy(zero_copy_only=False)], float)
                word = found.indices.to_numpy()
                value, text = values[word], np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
                uncommon = np.isnan(value)
                value[uncommon] = unknown  # unless the join finds them
                n_rare = np.bincount(text[uncommon], minlength=len(offsets) - 1)
                base = end + np.bincount(text, value, len(offsets) - 1)
                n_tokens = np.diff(begins) + 1
                n_known = n_tokens - n_rare - int(n_ends == 0)
                own, times = np.unique(text[uncommon] * len(values) + word[uncommon], return_counts=True)
                rare = found.dictionary.take(pa.array(own % max(len(values), 1)))
                until = (own // max(len(values), 1)).searchsorted(np.arange(len(offsets)))
                pairs = pa.StructArray.from_arrays(
                    [rare.cast(pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "times"]
                )
                parts.append(pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base), pa.array(scores), pa.ListArray.from_arrays(pa.array(until, pa.int32()), pairs)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                ))
        return pa.Table.from_batches(parts)

    chunks = sent.where(F.col("kind") == TEXTS).select("chunk", "payload")
    measured = stable(
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            measure,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
            "rare array<struct<word:string,times:int>>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    drop_table(sent)
    uncommon = words.where(F.col("n") < least)
    gained = (
        measured.select("row", F.inline("rare"))
        .join(uncommon, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * (F.log10((F.col("n") + 0.1) / 0.1))).alias("gain"), F.sum("times").alias("more"))
    )
    return measured.join(gained, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )
