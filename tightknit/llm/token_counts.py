"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are vocabulary strings that encode alone as one
token. Which strings do is proved once, for the vocabulary, by encoding each of
them. A task then counts pre-tokens: one for every proved string, and the
length of the merged encoding for the rest, each distinct rest merged once
while it stays in the task's table.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tightknit.llm.batches import id_text, pieces

# The vocabulary's own split of lower-cased text, its specials and its word end.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"
BEYOND_LATIN = re.compile("[^\0-\u036f]")

# Merged pre-tokens a task remembers before it starts its table anew.
REMEMBERED = 300_000


def _tokenizer(spec: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(spec)


def unusual_points() -> str:
    """Pattern of code points whose case or class may differ between Unicode versions, and the
    capital sigma, which Python lower-cases by its place in the word."""
    runs: list[list[int]] = []
    for code in range(0x110000):
        if code == 0x3A3 or unicodedata.category(chr(code)) == "Cn":
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]"


def is_plain(text: str, unusual: re.Pattern) -> bool:
    """True if splitting ``text.lower()`` by ``PIECES`` gives the library's pre-tokens."""
    if any(special in text for special in SPECIALS):
        return False
    if text.isascii():
        return True
    # Below U+0370 every code point is assigned and plain.
    return unicodedata.is_normalized("NFC", text) and not (BEYOND_LATIN.search(text) and unusual.search(text))


def byte_letters() -> dict[int, str]:
    """Byte-level letters by byte: visible Latin-1 stands for itself, the other bytes follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def whole_tokens(spec: str) -> set[str]:
    """Pre-tokens proved to encode alone as exactly one token."""
    tokenizer, split = _tokenizer(spec), regex.compile(PIECES)
    # Byte-level letters stand for bytes; only strings of ASCII letters, digits and signs look alike in both.
    words = [v.removesuffix(WORD_END) for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(WORD_END)]
    words = [w for w in words if w and w.isascii() and w == w.lower() and split.fullmatch(w)]
    codes = tokenizer.encode_batch(words, add_special_tokens=False)
    return {w for w, code in zip(words, codes) if len(code.ids) == 1}


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, *, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Tokens of every whole text as the tokenizers library counts them.

    ``vocabulary`` is the path of a tokenizers JSON file whose pre-tokenizer splits
    by ``PIECES``; the driver reads it and sends it along (its size is the
    vocabulary's, whatever the data). A null or empty text has no tokens. Texts
    with special strings, not in NFC or with unusual code points are encoded whole
    by the library. Rows are kept as they are, repeated ids too; other columns are
    ignored. Returns ``doc_id, n_bytes, n_tokens, over_limit``.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec), unusual_points()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole, points = shared.value
        tokenizer, split, unusual = _tokenizer(spec), regex.compile(PIECES), re.compile(points)
        lengths: dict[str, int] = dict.fromkeys(whole, 1)
        merge, letters = tokenizer.model.tokenize, byte_letters()
        for piece in pieces(batches):
            texts = piece.column(1).to_pylist()
            words = [split.findall(t.lower()) if is_plain(t, unusual) else None for t in texts]
            rest = {w for found in words if found for w in found}.difference(lengths)
            if len(lengths) + len(rest) > len(whole) + REMEMBERED:
                lengths = dict.fromkeys(whole, 1)
                rest = {w for found in words if found for w in found}.difference(lengths)
            for w in rest:
                lengths[w] = len(merge(w if w.isascii() else w.encode().decode("latin-1").translate(letters)))
            counts = [
                sum(map(lengths.__getitem__, found))
                if found is not None
                else len(tokenizer.encode(t, add_special_tokens=False).ids)
                for t, found in zip(texts, words)
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = id_text(docs, text=text, doc_id=doc_id).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
