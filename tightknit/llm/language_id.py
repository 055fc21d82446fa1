"""Language identification by a byte convolutional network.

Filters of several widths slide over fixed-length windows of bytes, the largest
answer of each filter over a window goes into a softmax over the languages.
Trained in numpy on windows of labelled texts; applied to all windows of every
text, whose probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, id_text, offsets_of, pieces, small_batches

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: Labelled texts per language that training reads, and the characters taken from each.
TRAIN_TEXTS, TRAIN_CHARS = 400, 2_000
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Filters as byte tables: ``filters[w][i]`` scores a byte at place i of a width-w filter."""

    languages: list[str]
    filters: list[np.ndarray]  # per width: [width, 256, n_filters]
    bias: np.ndarray  # [all filters]
    out: np.ndarray  # [all filters, languages]
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter over each window, and its place."""
        best, place = [], []
        for table in self.filters:
            width = len(table)
            n = windows.shape[1] - width + 1
            answer = table[0][windows[:, :n]]
            for i in range(1, width):
                answer += table[i][windows[:, i : i + n]]
            at = answer.argmax(axis=1)
            best.append(np.take_along_axis(answer, at[:, None], axis=1)[:, 0])
            place.append(at)
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(place, axis=1)

    def probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        """As ``features`` and softmax, with the pair tables of ``paired``."""
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        best = []
        for parts in tables:
            width = sum(size for size, _ in parts)
            n = windows.shape[1] - width + 1
            answer, at = None, 0
            for size, table in parts:
                index = pairs[:, at : at + n] if size == 2 else windows[:, at : at + n]
                answer = table[index] if answer is None else np.add(answer, table[index], out=answer)
                at += size
            best.append(answer.max(axis=1))
        hidden = np.maximum(np.concatenate(best, axis=1) + self.bias, 0)
        return softmax(hidden @ self.out + self.out_bias)

    def paired(self) -> list:
        """Each filter as tables over two bytes, and one over a byte where the width is odd."""
        found = []
        for table in self.filters:
            parts, i = [], 0
            while i < len(table):
                if i + 1 < len(table):
                    both = (table[i][:, None, :] + table[i + 1][None, :, :]).reshape(65536, -1)
                    parts.append((2, np.ascontiguousarray(both)))
                else:
                    parts.append((1, table[i]))
                i += 2
            found.append(parts)
        return found


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of each text cut into windows, the last one filled up with blanks; each window's row."""
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    starts = np.concatenate([[0], np.cumsum(counts)]) * window
    cells = np.full(int(starts[-1]), 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(starts[:-1] - offsets[:-1], lengths)
    cells[place] = data
    return cells.reshape(-1, window), np.repeat(np.arange(len(lengths)), counts)


def fit(
    texts: list[str], labels: list[str], *, filters: int = 8, epochs: int = 12, rate: float = 0.01, seed: int = 7
) -> ByteNet:
    """Train on the windows of labelled texts by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    column = pa.array(texts, pa.string())
    x, row = windows_of(bytes_of(column), offsets_of(column))
    y = np.array([languages.index(label) for label in labels])[row] if len(texts) else np.zeros(0, int)
    total = filters * len(WIDTHS)
    net = ByteNet(
        languages,
        [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    balance = len(y) / (len(languages) * np.maximum(share, 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 64):
            batch = order[start : start + 64]
            windows, target = x[batch], y[batch]
            answer, place = net.features(windows)
            hidden = np.maximum(answer, 0)
            slope = softmax(hidden @ net.out + net.out_bias)
            slope[np.arange(len(batch)), target] -= 1
            slope *= balance[target][:, None] / len(batch)
            back = (slope @ net.out.T) * (answer > 0)
            moves = []
            for k, table in enumerate(net.filters):
                move = np.zeros_like(table)
                cols = slice(k * filters, (k + 1) * filters)
                for i in range(len(table)):
                    byte = np.take_along_axis(windows, place[:, cols] + i, axis=1)
                    np.add.at(move[i], (byte, np.arange(filters)), back[:, cols])
                moves.append(move)
            moves += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for w, move, a, b in zip(weights, moves, first, second):
                a += 0.1 * (move - a)
                b += 0.001 * (move * move - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
    return net


def train_on(
    docs: DataFrame, usable: Column, *, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS, text: str = "text", lang: str = "lang"
) -> ByteNet:
    """Fit on at most ``texts`` different usable texts of each language, the first by a hash of the text.

    Copies of a text count once. Of a text of more than ``chars`` characters as many are read from a place
    anywhere in it that the hash draws; both bounds limit training only.
    """
    h = F.xxhash64(docs[text])
    spare = F.greatest(F.char_length(docs[text]) - chars, F.lit(0))
    drawn = F.substr(docs[text], (F.pmod(F.xxhash64(h), spare + 1) + 1).cast("int"), F.lit(chars))
    rows = docs.where(usable & docs[lang].isNotNull() & docs[text].isNotNull()).select(
        drawn.alias("text"), docs[lang].alias("lang"), h.alias("h")
    )
    # Only hashes are shuffled, and the rank limit is pushed below the shuffle of the ranks.
    first = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= texts)
    # At most ``texts`` hashes of a language; a task sends one text for each of them.
    sample = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = sample.select("text", "lang").toArrow().to_pydict()
    pairs = sorted((x, y) for x, y in zip(found["text"], found["lang"]) if LETTER.search(x))
    return fit([x for x, _ in pairs], [y for _, y in pairs])


def _predict(net: ByteNet, tables: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text, none of them null."""
    n = len(texts)
    lettered = np.array([LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    names, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if net.languages and lettered.any():
        windows, row = windows_of(bytes_of(texts), offsets_of(texts))
        total = np.zeros((n, len(net.languages)))
        for start in range(0, len(windows), 2048):
            part = net.probabilities(windows[start : start + 2048], tables)
            np.add.at(total, row[start : start + 2048], part)
        total /= np.maximum(np.bincount(row, minlength=n), 1)[:, None]
        best = total.argmax(axis=1)
        names[lettered] = np.array(net.languages, object)[best[lettered]]
        score[lettered] = np.clip(total[np.arange(n), best], 0, 1)[lettered]
    return names, score


def identify(docs: DataFrame, net: ByteNet, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score``, one row per row of ``docs``.

    The score is the mean probability over the text's windows. A null text or one
    without a letter, and any text if nothing was learned, gets ``und`` with score 0.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.paired() if net.languages else []
        for piece in pieces(batches):
            names, score = _predict(net, tables, piece.column(1))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return id_text(docs, text=text, doc_id=doc_id).mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def of_known_language(docs: DataFrame, net: ByteNet, *, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a known language with a score of ``least``, with their columns.

    By default only what ``identify`` calls ``und`` goes, so that texts of two languages stay. If nothing was
    learned, all rows are kept.
    """
    small_batches(docs)
    if not net.languages:
        return docs

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.paired()
        for piece in pieces(batches, text, n_bytes=1 << 20):
            texts = pc.fill_null(piece.column(piece.schema.get_field_index(text)), "")
            names, score = _predict(net, tables, texts)
            yield piece.filter(pa.array((names != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(choose, docs.schema)
