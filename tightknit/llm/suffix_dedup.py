"""Exact repeats of bytes between documents, found by a hash-compared suffix sort.

Every stretch of ``SIZE`` bytes holds an anchor: the ``GRAM`` bytes whose hash is
the smallest among its grams. Equal stretches have equal anchors, so only
suffixes that begin at anchors seen in two places need sorting. They are dealt
to tasks by the anchor, each with as much context to both sides as a stretch
can reach. A task sorts the suffixes of each anchor by merging; two are compared by
the length of their common extension, found by binary search over prefix polynomial
hashes. In the sorted order the suffixes that agree far enough to the right are
neighbors; among these, equal hashes of what stands to the left make equal
stretches, of which the smallest document is the first. Bytes are compared before a stretch counts.

A task keeps consecutive documents as a chunk of bounded size, which is shuffled once, compressed, for the three
steps that read it. A chunk asks once for each of its anchors whether another chunk has it, and sends
each distinct context once, whatever the number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, offsets_of, pieces, small_batches
from tightknit.llm.shingles import mix

SIZE, GRAM = 50, 24
REACH = SIZE - GRAM  # bytes to either side of an anchor that one stretch can hold
WIDTH = GRAM + 2 * REACH

#: Bytes of text after which a chunk is full, those searched for anchors at once, and contexts handled at once.
CHUNK, SLICE, ROWS = 16 << 20, 1 << 20, 20_000

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_TOP = np.uint64(2**64 - 1)
#: Of the polynomial hashes: values of bytes, and a power for each column.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.full(WIDTH, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values."""
    pick, have = (np.minimum if least else np.maximum), 1
    while 2 * have <= width:
        x, have = pick(x[: len(x) - have], x[have:]), 2 * have
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of some texts; none lies over the end of a text."""
    n, window = len(data) - GRAM + 1, SIZE - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = mix(sum((eight[8 * i : n + 8 * i] * _FACTORS[i] for i in range(3)), np.zeros(n, np.uint64)))
    h = np.minimum(h, _TOP - np.uint64(1))
    cut = np.zeros(n + GRAM, np.int8)
    for t in offsets[1:-1]:  # grams over the end of a text
        cut[max(int(t) - GRAM + 1, 0) : int(t)] = 1
    h[cut[:n] > 0] = _TOP
    small = _sliding(h, window, True)
    edge = np.zeros(window - 1, np.uint64)
    chosen = (h == _sliding(np.concatenate([edge, small, edge]), window, False)) & (h != _TOP)
    at = np.flatnonzero(chosen)
    return at, h[at]


class Chunk:
    """The texts of one chunk, and the anchors of those with an id; equal rows count once."""

    def __init__(self, blob: bytes):
        self.valid, self.all_ids, self.all_versions, lengths, self.bytes = _unpack(blob, "?", "<i8", "<i8", "<i8", "u1")
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        known = np.flatnonzero(self.valid)
        pairs = np.stack([self.all_ids[known], self.all_versions[known]])
        first = np.unique(pairs, axis=1, return_index=True)[1] if len(known) else known
        rows = np.sort(known[first])
        self.ids, self.version = self.all_ids[rows], self.all_versions[rows]
        keep = np.zeros(len(lengths), bool)
        keep[rows] = True
        self.data = self.bytes if keep.all() else self.bytes[np.repeat(keep, lengths)]
        self.offsets = np.concatenate([[0], np.cumsum(lengths[rows])])

    def find_anchors(self) -> "Chunk":
        places, hashes, start = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while start < len(self.ids):
            stop = max(int(np.searchsorted(self.offsets, self.offsets[start] + SLICE, side="right")) - 1, start + 1)
            a, b = self.offsets[start], self.offsets[stop]
            at, h = anchors(self.data[a:b], self.offsets[start : stop + 1] - a)
            places.append(at + a)
            hashes.append(h)
            start = stop
        self.places, self.hashes = np.concatenate(places), np.concatenate(hashes)
        return self


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        found.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return found


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def _place(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an anchor, and the 32 bits that stand for it there."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64), hashes.astype(np.uint32)


def asked(chunk: Chunk, n: int) -> Iterator[tuple[int, bytes]]:
    """The chunk's distinct anchors by bucket."""
    for bucket, rows in _by_bucket(_place(chunk.hashes, n)[0]):
        yield bucket, _pack(np.unique(chunk.hashes[rows].astype(np.uint32)))


def contexts(chunk: Chunk, places: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each anchor, its text's ends filled up with zeros, and how far they reach."""
    left = np.minimum(places - chunk.offsets[row], REACH)
    right = np.minimum(chunk.offsets[row + 1] - places - GRAM, REACH)
    column = np.arange(WIDTH) - REACH
    inside = (column >= -left[:, None]) & (column < GRAM + right[:, None])
    at = np.clip(places[:, None] + column, 0, max(len(chunk.data) - 1, 0))
    return np.where(inside, chunk.data[at], 0).astype(np.uint8), left, right


def prefix_hashes(cells: np.ndarray) -> np.ndarray:
    """Polynomial hash of the first j bytes of each row, for j up to the width."""
    sums = np.zeros((len(cells), WIDTH + 1), np.uint64)
    for i in range(0, len(cells), ROWS):
        np.cumsum(_VALUES[cells[i : i + ROWS]] * _POWERS, axis=1, dtype=np.uint64, out=sums[i : i + ROWS, 1:])
    return sums


FIELDS = ("<u8", "<i8", "<i8", "u1", "u1", "u1", "<i4", "<i4")
SPANS = ("<i8", "<i8", "<i4", "<i4")


def sent(chunk: Chunk, known: list[tuple[int, bytes]], n: int) -> Iterator[tuple[int, bool, bytes]]:
    """Contexts of anchors met twice, by bucket, and the spans that copies in the chunk settle."""
    bucket, short = _place(chunk.hashes, n)
    row = np.searchsorted(chunk.offsets, chunk.places, side="right") - 1
    key = bucket.astype(np.uint64) << np.uint64(32) | short
    elsewhere = [np.uint64(b) << np.uint64(32) | _unpack(x, "<u4")[0].astype(np.uint64) for b, x in known]
    wanted = np.isin(key, np.concatenate(elsewhere)) if elsewhere else np.zeros(len(key), bool)
    order = np.lexsort((chunk.ids[row], key))
    new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    group = np.cumsum(new_key) - 1
    if len(key):  # anchors of two documents of this chunk
        own = chunk.ids[row[order]]
        first, last = np.flatnonzero(new_key), np.append(np.flatnonzero(new_key)[1:], len(key)) - 1
        wanted[order[(own[first] != own[last])[group]]] = True
    at = np.flatnonzero(wanted)
    for part in np.array_split(at, max(1, -(-len(at) // 100_000))) if len(at) else []:
        yield from _sent_part(chunk, part, row, bucket)


def _sent_part(chunk: Chunk, at: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
    cells, left, right = contexts(chunk, chunk.places[at], row[at])
    enough = left + GRAM + right >= SIZE
    at, cells, left, right = at[enough], cells[enough], left[enough], right[enough]
    if not len(at):
        return
    row, bucket, hashes, place = row[at], bucket[at], chunk.hashes[at], chunk.places[at]
    start = place - chunk.offsets[row]
    mark = mix(prefix_hashes(cells)[:, -1] + (left * 64 + right).astype(np.uint64))
    order = np.lexsort((start, chunk.version[row], chunk.ids[row], mark))
    new = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (cells[order] == cells[head]).all(axis=1) & (left[order] == left[head]) & (right[order] == right[head])
    later = same & (chunk.ids[row[order]] > chunk.ids[row[head]])
    done = order[later]  # a copy of the context stands in a smaller document of the chunk
    if len(done):
        yield 0, True, _pack(
            chunk.ids[row[done]], chunk.version[row[done]],
            (start[done] - left[done]).astype(np.int32), (start[done] + GRAM + right[done]).astype(np.int32),
        )
    rest = order[~later]
    # A context of one document travels once, with all its places.
    fresh = np.ones(len(rest), bool)
    fresh[1:] = (
        (mark[rest][1:] != mark[rest][:-1]) | (row[rest][1:] != row[rest][:-1])
        | (cells[rest][1:] != cells[rest][:-1]).any(axis=1)
    )
    leads = np.flatnonzero(fresh)
    count = np.diff(np.append(leads, len(rest))).astype(np.int32)
    for b, own in _by_bucket(bucket[rest[leads]]):
        i = rest[leads[own]]
        rows_ = np.repeat(leads[own], count[own]) + np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        yield b, False, _pack(
            hashes[i], chunk.ids[row[i]], chunk.version[row[i]], left[i].astype(np.uint8), right[i].astype(np.uint8),
            cells[i].ravel(), count[own], start[rest[rows_]].astype(np.int32),
        )


class Suffixes:
    """Suffixes that begin at anchors, grouped by anchor, and their order."""

    def __init__(self, cells: np.ndarray, left: np.ndarray, right: np.ndarray, hashes: np.ndarray):
        self.cells, self.left, self.right = cells, left.astype(np.int64), right.astype(np.int64)
        self.sums = prefix_hashes(cells)
        self.order = np.argsort(hashes, kind="stable")
        moved = hashes[self.order][1:] != hashes[self.order][:-1]
        self.first = np.flatnonzero(np.concatenate([[True], moved])[: len(hashes)])
        self.size = np.diff(np.append(self.first, len(hashes)))
        self.sort()
        self.common = self.neighbors()
        if not self.in_order():  # two prefixes of one hash misled the search: by the bytes instead
            suffix = cells[:, REACH : REACH + SIZE]
            self.order = np.lexsort((self.right, *suffix.T[::-1], hashes))
            self.common = self.neighbors()

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of two suffixes, by binary search over the hashes of their prefixes."""
        low, high = np.zeros(len(a), np.int64), GRAM + np.minimum(self.right[a], self.right[b])
        base_a, base_b = self.sums[a, REACH], self.sums[b, REACH]
        for _ in range(SIZE.bit_length()):
            middle = (low + high + 1) // 2
            equal = self.sums[a, REACH + middle] - base_a == self.sums[b, REACH + middle] - base_b
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def precedes(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` stands before ``b``; equal ones do where ``ties`` says so."""
        common = self.extension(a, b)
        end_a, end_b = common == GRAM + self.right[a], common == GRAM + self.right[b]
        column = np.minimum(REACH + common, WIDTH - 1)
        byte_a = np.where(end_a, -1, self.cells[a, column].astype(np.int64))
        byte_b = np.where(end_b, -1, self.cells[b, column].astype(np.int64))
        return (byte_a < byte_b) | ((byte_a == byte_b) & ties)

    def sort(self) -> None:
        """Merge neighboring runs of every group, all groups at once, until each is one run."""
        width = 1
        while True:
            live = self.size > width
            if not live.any():
                return
            length = self.size[live]
            base = np.repeat(self.first[live], length)
            inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            end = np.repeat(self.first[live] + length, length)
            run = inner // width
            other = np.minimum(base + (run ^ 1) * width, end)
            until = np.minimum(other + width, end)
            own = self.order[base + inner]
            low, high = other.copy(), until.copy()
            ahead = run % 2 == 1  # of equal suffixes those of the left run come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                before = self.precedes(self.order[middle], own[open_], ahead[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            target = base + (run // 2) * 2 * width + inner % width + (low - other)
            self.order[target] = own
            width *= 2

    def neighbors(self) -> np.ndarray:
        """Common bytes of each suffix in the order with the one before it, -1 at a group's first."""
        common = np.full(len(self.order), -1, np.int64)
        for i in range(1, len(self.order), 100_000):
            a, b = self.order[i - 1 : i + 99_999], self.order[i : i + 100_000]
            a = a[: len(b)]
            differ = self.cells[a, REACH : REACH + SIZE] != self.cells[b, REACH : REACH + SIZE]
            until = np.where(differ.any(axis=1), differ.argmax(axis=1), SIZE)
            common[i : i + 100_000] = np.minimum(until, GRAM + np.minimum(self.right[a], self.right[b]))
        common[self.first] = -1
        return common

    def in_order(self) -> bool:
        """Whether every suffix follows the one before it, by the bytes behind what they share."""
        at = np.flatnonzero(self.common >= 0)
        a, b, common = self.order[at - 1], self.order[at], self.common[at]
        column = np.minimum(REACH + common, WIDTH - 1)
        ended = common == GRAM + self.right[a]
        return bool(np.all(ended | ((common < GRAM + self.right[b]) & (self.cells[a, column] < self.cells[b, column]))))


def covered(s: Suffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the most and the least bytes left of it in a stretch that a smaller document has too.

    Both are -1 where there is none. Stretches around one anchor overlap, so these two say it all.
    """
    n = len(ids)
    most, least = np.full(n, -1), np.full(n, -1)
    common, order = s.common, s.order
    for reach in range(REACH + 1):
        fits = (s.left[order] >= reach) & (s.right[order] >= REACH - reach)
        run = np.cumsum(common < SIZE - reach)
        at = order[fits]
        if len(at) < 2:
            continue
        behind = s.sums[at, REACH] - s.sums[at, REACH - reach]
        key = mix(behind ^ mix(run[fits].astype(np.uint64)))
        by = np.lexsort((ids[at], key))
        new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        head = at[by[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        own = at[by]
        found = ids[own] > ids[head]
        own, head = own[found], head[found]
        window = slice(REACH - reach, REACH - reach + SIZE)
        equal = np.ones(len(own), bool)
        for i in range(0, len(own), 100_000):
            equal[i : i + 100_000] = (s.cells[own[i : i + 100_000], window] == s.cells[head[i : i + 100_000], window]).all(axis=1)
        if not equal.all():  # two different stretches of one hash: by their bytes instead
            stretch = np.ascontiguousarray(s.cells[at, window]).view(f"V{SIZE}").ravel()
            group = np.unique(stretch, return_inverse=True)[1]
            lowest = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, group, ids[at])
            own = at[ids[at] > lowest[group]]
        most[own] = reach
        least[own] = np.where(least[own] < 0, reach, least[own])
    return most, least


def settled(payloads: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Spans for each of a bucket's payloads, by its number."""
    parts = [_unpack(x, *FIELDS) for x in payloads]
    hashes, ids, version, left, right, cells, count, starts = (np.concatenate(x) for x in zip(*parts))
    cells = cells.reshape(-1, WIDTH)
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    # Anchors of one document only cannot repeat another's.
    most, least = covered(Suffixes(cells, left, right, hashes), ids)
    first = np.cumsum(count) - count
    numbers, spans = [], []
    hit = most >= 0
    for k, own in _by_bucket(np.where(hit, source, -1)):
        if k < 0:
            continue
        rows = np.repeat(own, count[own])
        at = np.repeat(first[own], count[own]) + np.arange(len(rows)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        begin = starts[at] - most[rows]
        stop = starts[at] - least[rows] + SIZE
        numbers.append(k)
        spans.append(_pack(ids[rows], version[rows], begin.astype(np.int32), stop.astype(np.int32)))
    return numbers, spans


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each text as bytes without what a smaller document has too.

    A byte goes if it lies in ``SIZE`` equal bytes that also start in a document with a smaller id.
    ``spans`` are the maximal removed runs ``(start, stop)`` in order, ``kept`` the remaining
    bytes. One row per row of ``docs``; null texts are empty. Rows without an id lose nothing and take nothing from
    others; rows with equal ids lose nothing to each other.
    """
    small_batches(docs)
    rows = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    )
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // CHUNK))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def full() -> pa.RecordBatch:
            ids = pa.concat_arrays([x.column(0) for x in held])
            blob = _pack(
                ids.is_valid().to_numpy(zero_copy_only=False),
                ids.fill_null(0).to_numpy(),
                pa.concat_arrays([x.column(1) for x in held]).to_numpy(),
                np.concatenate([np.diff(offsets_of(x.column(2))) for x in held]),
                np.concatenate([bytes_of(x.column(2)) for x in held]),
            )
            # Named by what it holds, so that a repeated task gives the same name.
            name = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)
            held.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        size = 0
        for piece in pieces(batches):
            held.append(piece)
            size += int(offsets_of(piece.column(2))[-1])
            if size >= CHUNK:
                yield full()
                size = 0
        if held:
            yield full()

    def table(names: list[str], columns: list[list], kinds: list[pa.DataType]) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(asked(Chunk(blob).find_anchors(), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in found], pa.int32()), pa.array([name] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())],
                    ["bucket", "chunk", "hashes"],
                )

    def answer(part: pa.Table) -> pa.Table:
        lists = [_unpack(x, "<u4")[0] for x in part.column("hashes").to_pylist()]
        values, held = np.unique(np.concatenate(lists), return_counts=True)
        twice = values[held > 1]
        back = [_pack(x[np.isin(x, twice, assume_unique=True)]) for x in lists]
        return part.select(["bucket", "chunk"]).append_column("hashes", pa.array(back, pa.binary()))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        known = list(zip(right.column("bucket").to_pylist(), right.column("hashes").to_pylist()))
        for name, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist()):
            found += [(b, name, done, x) for b, done, x in sent(Chunk(blob).find_anchors(), known, n)]
        columns = [list(c) for c in zip(*found)] or [[], [], [], []]
        # Settled spans only pass through; they go by the chunk's name.
        columns[0] = [name % n if done else b for b, name, done, _ in found]
        return table(["bucket", "chunk", "done", "payload"], columns, [pa.int32(), pa.int64(), pa.bool_(), pa.binary()])

    def settle(part: pa.Table) -> pa.Table:
        chunks, done, payload = (part.column(c).to_pylist() for c in ("chunk", "done", "payload"))
        out = [(c, x) for c, d, x in zip(chunks, done, payload) if d]
        todo = [(c, x) for c, d, x in zip(chunks, done, payload) if not d]
        if todo:
            numbers, spans = settled([x for _, x in todo])
            out += [(todo[k][0], x) for k, x in zip(numbers, spans)]
        return table(["chunk", "spans"], [[c for c, _ in out], [x for _, x in out]], [pa.int64(), pa.binary()])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_unpack(x, *SPANS) for x in right.column("spans").to_pylist()]
        ids, version, begin, stop = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((begin, version, ids))
        ids, version, begin, stop = ids[order], version[order], begin[order], stop[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (version[1:] != version[:-1])])[: len(ids)])
        until = np.append(first[1:], len(ids))
        own = {(int(ids[a]), int(version[a])): (a, b) for a, b in zip(first, until)}
        doc_ids, sizes, spans, kept = [], [], [], []
        for blob in left.column("blob").to_pylist():
            chunk = Chunk(blob)
            for i, (known, doc, v) in enumerate(zip(chunk.valid.tolist(), chunk.all_ids.tolist(), chunk.all_versions.tolist())):
                data = chunk.bytes[chunk.ends[i] : chunk.ends[i + 1]].tobytes()
                a, b = own.get((doc, v), (0, 0)) if known else (0, 0)
                runs: list[list[int]] = []
                for s, e in zip(begin[a:b].tolist(), stop[a:b].tolist()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                edges = [0, *(x for run in runs for x in run), len(data)]
                doc_ids.append(doc if known else None)
                sizes.append(len(data))
                spans.append([{"start": s, "stop": e} for s, e in runs])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
        pair = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        return table(
            ["doc_id", "n_bytes", "spans", "kept"],
            [doc_ids, sizes, spans, kept],
            [pa.int64(), pa.int64(), pa.list_(pair), pa.binary()],
        )

    chunks = rows.mapInArrow(gather, "chunk bigint, blob binary").repartition(n, "chunk")
    by_chunk = chunks.groupBy("chunk")
    answered = (
        chunks.mapInArrow(ask, "bucket int, chunk bigint, hashes binary")
        .groupBy("bucket")
        .applyInArrow(answer, "bucket int, chunk bigint, hashes binary")
    )
    spans = (
        by_chunk.cogroup(answered.groupBy("chunk"))
        .applyInArrow(send, "bucket int, chunk bigint, done boolean, payload binary")
        .groupBy("bucket")
        .applyInArrow(settle, "chunk bigint, spans binary")
    )
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary"
    )
