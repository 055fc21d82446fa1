"""Quality rules as a short-circuit cascade.

Each rule looks at one measure of a text. On a bounded sample every rule is
timed and its share of rejected texts counted; the cascade then asks first the
rule that rejects most per second, and asks a rule only about the texts that
all earlier ones let pass. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, id_text, offsets_of, pieces, sums_by_row

# White space between words, and the symbols that are counted.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"

SAMPLE_ROWS = 400


class Texts:
    """Measures of a slice of texts; each is computed when a rule first asks for it."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = bytes_of(column), offsets_of(column)
        self.n = len(self.offsets) - 1
        self.known: dict[str, np.ndarray] = {}

    def take(self, rows: np.ndarray) -> "Texts":
        """The same texts without the others; measures already known are kept."""
        part = Texts(pa.array([], pa.string()))
        lengths = np.diff(self.offsets)[rows]
        part.offsets = np.concatenate([[0], np.cumsum(lengths)])
        keep = np.zeros(self.n, bool)
        keep[rows] = True
        part.data = self.data[np.repeat(keep, np.diff(self.offsets))]
        part.n = len(rows)
        part.known = {k: v[rows] for k, v in self.known.items()}
        return part

    def count(self, name: str, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that ``table`` marks."""
        if name not in self.known:
            self.known[name] = sums_by_row(table[self.data].astype(np.int64), self.offsets)
        return self.known[name]


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE, SYMBOL = _marks(SPACES), _marks(SYMBOLS)
#: Bytes that begin a code point and are not white space.
CHAR = ~SPACE & ~((np.arange(256) & 0xC0) == 0x80)
UPPER, LETTER = _marks(bytes(range(65, 91))), _marks(bytes([*range(65, 91), *range(97, 123)]))
DIGIT, BANG = _marks(b"0123456789"), _marks(b"!?")


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a word ends at white space or with its text."""
    solid = ~SPACE[data]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes, equal exactly for equal bytes."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    values = data[np.repeat(starts, lengths) + within]
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(codes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> np.ndarray:
    """Words of each row that lie in a ``width``-word window found twice or more in the row.

    Windows are numbered exactly, two words at a time, so that equal numbers mean equal windows.
    """
    n = len(codes)
    if n < width + 1:
        return np.zeros(n_rows, np.int64)
    ids, have = codes, 1
    while have < width:
        step = min(have, width - have)
        left, right = ids[: len(ids) - step], ids[step:]
        ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    inside = rows[: n - width + 1] == rows[width - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    key = rows[at] * (int(ids.max()) + 1) + ids[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    found = at[order[twice]]
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return np.bincount(rows[np.cumsum(edge)[:-1] > 0], minlength=n_rows).astype(np.int64)


def base_measures(texts: Texts) -> dict[str, np.ndarray]:
    """The exact measures every row carries: words, their characters, symbols, repeats."""
    data, offsets, n = texts.data, texts.offsets, texts.n
    starts, ends = word_spans(data, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    known = texts.known
    known["n_words"] = np.bincount(rows, minlength=n).astype(np.int64)
    texts.count("word_chars", CHAR)
    texts.count("n_symbols", SYMBOL)
    # Lines: cut at line feeds and at ends of texts; those without a word do not count.
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, end = cuts[:-1], cuts[1:]
    words_before = np.searchsorted(starts, cuts)
    real = np.diff(words_before) > 0
    begin, end = begin[real], end[real]
    end = end - (data[end - 1] == 10)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    lines = _coded(data, begin, end)
    known["n_lines"] = np.bincount(owner, minlength=n).astype(np.int64)
    if len(lines):
        distinct = np.unique(owner * (int(lines.max()) + 1) + lines) // (int(lines.max()) + 1)
        known["n_dup_lines"] = known["n_lines"] - np.bincount(distinct, minlength=n)
    else:
        known["n_dup_lines"] = np.zeros(n, np.int64)
    codes = _coded(data, starts, ends)
    known["n_repeat_words"] = repeated_words(codes, rows, n)
    stutter = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])  # a word right after itself
    known["n_stutter_words"] = np.bincount(rows[1:][stutter], minlength=n).astype(np.int64)
    return known


@dataclass(frozen=True)
class Rule:
    """``passes(texts)`` marks the texts that the rule lets pass."""

    name: str
    passes: Callable[[Texts], np.ndarray]


#: Shares are of words, lines or letters as named; bounds are generous, so that prose passes.
RULES = (
    Rule("symbols", lambda t: 10 * t.count("n_symbols", SYMBOL) <= 3 * t.known["n_words"]),
    Rule("duplicate_lines", lambda t: 10 * t.known["n_dup_lines"] <= 3 * t.known["n_lines"]),
    Rule("word_length", lambda t: t.count("word_chars", CHAR) <= 15 * t.known["n_words"]),
    Rule("short_words", lambda t: t.count("word_chars", CHAR) >= 2 * t.known["n_words"]),
    Rule("capitals", lambda t: 2 * t.count("upper", UPPER) <= t.count("letters", LETTER)),
    Rule("digits", lambda t: 2 * t.count("digits", DIGIT) <= t.count("word_chars", CHAR)),
    Rule("exclamations", lambda t: 10 * t.count("bangs", BANG) <= 5 * t.known["n_words"]),
)


def ordered_rules(sample: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejected texts per second on the sample, most first."""
    gain = []
    for rule in rules:
        texts = Texts(sample)
        base_measures(texts)
        began = time.perf_counter()
        rejected = int(np.sum(~rule.passes(texts)))
        gain.append(((rejected + 0.5) / (time.perf_counter() - began + 1e-6), rule))
    return [rule for _, rule in sorted(gain, key=lambda x: -x[0])]


def cascade(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """True for the texts that every rule lets pass; later rules see fewer texts."""
    kept, rows = np.ones(texts.n, bool), np.arange(texts.n)
    for rule in rules:
        if not len(rows):
            break
        passed = rule.passes(texts)
        kept[rows[~passed]] = False
        if 4 * passed.sum() < 3 * len(rows):  # cheaper without the rejected texts
            rows, texts = rows[passed], texts.take(np.flatnonzero(passed))
    return kept


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    sample_rows: int = SAMPLE_ROWS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Base measures of every text and whether it is kept.

    The order of the rules is estimated on at most ``sample_rows`` texts of 20,000
    characters at most; measures and verdicts cover every row and whole texts. A
    null or empty text has zero words and fails the base rule. Repeated ids and rows stay as they are.
    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept``.
    """
    rows = id_text(docs, text=text, doc_id=doc_id)
    sample = rows.select(F.substring("text", 1, 20_000).alias("text")).limit(sample_rows).toArrow()
    order = ordered_rules(pa.array(sample.column(0).to_pylist(), pa.string()), rules) if sample.num_rows else list(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = Texts(piece.column(1))
            known = base_measures(texts)
            n_words, repeats = known["n_words"], known["n_repeat_words"]
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            kept = np.zeros(texts.n, bool)
            left = np.flatnonzero(~failed)
            kept[left] = cascade(texts.take(left), order)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(known[k], pa.int64()) for k in names), pa.array(failed), pa.array(kept)],
                ["doc_id", *names, "base_failed", "kept"],
            )

    return rows.mapInArrow(
        judge,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean",
    )
