"""Spelling variants by permuterm rotations.

Every word ends with a terminator and is rotated in all ways: ``y$xc`` is the rotation of ``xcy$`` that ends with the
character c. Words that differ in that character alone have rotations with the common prefix ``y$x`` and one character
behind it, and the word without it, ``xy``, is the rotation ``y$x`` itself. So in the sorted rotations each prefix, the
edited character skipped, is a range that holds all replacements and indels at one place: at most one word as a whole,
and one word for each character. A scan over the range gives every member its number of neighbors and the first of
them, without any pair of them becoming a row.

A replacement meets in one range. An indel meets once for each character of the run of equal ones it edits, and counts
at the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tightknit.plans.stable import stable, stable_measured

#: Letters of a word, as the character class of the pattern.
LETTER = r"[A-Za-zÀ-ÿ]"

#: Prefixes of up to so many characters are compared as they are, longer ones by a hash of 124 bits.
PLAIN = 64

#: Rotations handed on at once.
ROWS = 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIMES = [2147483647, 2147483629, 2147483587, 2147483579]
_BASES = [1000000007 % 2147483647, 998244353, 1234567891, 1073807359]


def counted_words(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shortest: int = 7, fewest: int = 2, thin: int = 31
) -> DataFrame:
    """``word, n``: the words of all texts and how often they occur, from ``fewest`` times on.

    Words are maximal runs of letters (ASCII and U+00C0 to U+00FF), A-Z in lower case. Let h be the crc32 of
    ``<id>:<run>``: where ``thin`` divides it, the run loses its character ``h % length``. A null id is written as
    nothing; null and empty texts have no words.
    """
    runs = F.regexp_extract_all(docs[text], F.lit(f"({LETTER}{{{shortest},}})"), F.lit(0))
    ids = F.coalesce(docs[doc_id].cast("string"), F.lit(""))
    found = docs.select(ids.alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = found.select(F.when(F.col("h") % thin == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= fewest)


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id``, their place in code-point order, as a stored table.

    Ranges are sorted and numbered each for itself; the numbers of words in the ranges before come from one row a
    partition.
    """
    ranged = stable(words.repartitionByRange("word").withColumn("p", F.spark_partition_id()))
    held = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("p", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("word")) - 1
    placed = ranged.withColumn("place", place).join(F.broadcast(before), "p")
    return stable(placed.select("word", "n", (F.col("before") + F.col("place")).alias("id")))


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, edge, fresh, id, n``: every rotation of every word, once without its last character, the ``edge``,
    and once as a whole (empty edge). ``fresh`` marks the first of equal characters in a row."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, edges, fresh, ids, counts = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(prefixes, pa.string()), pa.array(edges, pa.string()), pa.array(fresh, pa.bool_())]
            columns += [pa.array(ids, pa.int64()), pa.array(counts, pa.int64())]
            for column in (prefixes, edges, fresh, ids, counts):
                column.clear()
            return pa.RecordBatch.from_arrays(columns, ["prefix", "edge", "fresh", "id", "n"])

        for batch in batches:
            for word, n, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size = len(word)
                for first in range(0, size + 1, ROWS):
                    last = min(first + ROWS, size + 1)
                    edited = word[first : min(last, size)]
                    prefixes += _prefixes(word, first, first + len(edited), 1)
                    prefixes += _prefixes(word, first, last, 0)
                    edges += [*edited, *[""] * (last - first)]
                    previous = (word[first - 1] if first else "") + edited
                    starts = [c != b for b, c in zip(previous, edited)] if first else [True, *(c != b for b, c in zip(edited, edited[1:]))]
                    fresh += [*starts, *[False] * (last - first)]
                    ids += [own] * (len(prefixes) - len(ids))
                    counts += [n] * (len(prefixes) - len(counts))
                    if len(prefixes) >= ROWS:
                        yield flush()
        if prefixes:
            yield flush()

    return words.select("word", "n", "id").mapInArrow(
        rotate, "prefix string, edge string, fresh boolean, id bigint, n bigint"
    )


def near_words(rotated: DataFrame) -> DataFrame:
    """``id, n_near, near_n, near_id``: how many words are near, and the most frequent of them (ties: least id)."""
    entry = F.struct((-F.col("n")).alias("minus_n"), "id")
    whole, edited = F.col("edge") == "", F.when(F.col("edge") != "", entry)
    order = Window.partitionBy("prefix").orderBy("edge")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = rotated.select(
        "id", "fresh", whole.alias("whole"),
        F.min(edited).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min(edited).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        F.count(edited).over(everything).alias("n_edited"),
        F.count_if("fresh").over(everything).alias("n_fresh"),
        F.min(F.when(F.col("fresh"), entry)).over(everything).alias("first_fresh"),
        F.min(F.when(whole, entry)).over(everything).alias("shorter"),
    )
    shorter = F.when(F.col("fresh"), F.col("shorter"))
    n_near = F.when(F.col("whole"), F.col("n_fresh")).otherwise(
        F.col("n_edited") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
    )
    near = F.when(F.col("whole"), F.col("first_fresh")).otherwise(F.least("before", "after", shorter))
    found = scanned.select("id", n_near.alias("n_near"), near.alias("near")).where("n_near > 0")
    found = found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    return found.select("id", "n_near", (-F.col("near.minus_n")).alias("near_n"), F.col("near.id").alias("near_id"))


def spelling_forms(words: DataFrame, *, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words(word, n)``, each word once.

    Two words are near if one inserted, deleted or replaced code point makes them equal. The form of a word is its near
    word of largest n (ties: the smallest in code-point order) if that n is ``factor`` times its own or more, else
    null. ``root`` is the last word reached by following forms, or the word itself.
    """
    named = numbered(words)
    near = near_words(rotations(named))
    known = stable(named.join(near, "id", "left"))
    has_form = F.coalesce(F.col("near_n") >= F.col("n") * factor, F.lit(False))
    n_near = F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")
    formed = known.where(has_form).select("id", "word", "n", n_near, F.col("near_n").alias("form_n"), F.col("near_id").alias("form_id"))
    roots = stable(formed.select("id", F.col("form_id").alias("root_id")))
    while True:
        # Each round doubles the steps taken; n grows by the factor with each step, so there are few.
        further = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        moved = roots.join(further, "root_id", "left").select(
            "id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")
        )
        roots, seen = stable_measured(moved, moved=F.count_if("moved"))
        roots = roots.select("id", "root_id")
        if not seen["moved"]:
            break
    names = named.select("id", "word")
    with_form = (
        formed.join(roots, "id")
        .join(names.toDF("form_id", "form"), "form_id")
        .join(names.toDF("root_id", "root"), "root_id")
        .select("word", "form", "root", "n", "n_near", "form_n")
    )
    without = known.where(~has_form).select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", n_near,
        F.lit(None).cast("bigint").alias("form_n"),
    )
    return with_form.unionByName(without)


def _prefixes(word: str, first: int, last: int, skipped: int) -> list[str]:
    """The rotations that start behind ``skipped`` characters at the places from ``first`` up to ``last``,
    without the skipped ones; hashed if they are long."""
    size = len(word) + 1 - skipped
    if size <= PLAIN:
        turned = f"{word}${word}"
        return [turned[i + skipped : i + skipped + size] for i in range(first, last)]
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts = [_hashes(codes, np.arange(first, last), skipped, p, b) for p, b in zip(_PRIMES, _BASES)]
    return ["#" + ":".join(map(str, (size, *row))) for row in zip(*(part.tolist() for part in parts))]


def _hashes(codes: np.ndarray, at: np.ndarray, skipped: int, prime: int, base: int) -> np.ndarray:
    """Polynomial hash of ``y$x`` for every place: x is what stands before it, y what follows the skipped characters."""
    p, n = np.uint64(prime), len(codes)
    powers = _powers(base, n + 2, prime)
    back = _powers(pow(base, -1, prime), n + 2, prime)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:n] % p, dtype=np.uint64) % p])
    y = (sums[n] + p - sums[at + skipped]) % p * back[at + skipped] % p
    behind = n - at - skipped
    return (y + np.uint64(ord("$")) * powers[behind] + sums[at] * powers[behind + 1] % p) % p


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    found = np.ones(1, np.uint64)
    while len(found) < n:
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), prime)) % np.uint64(prime)])
    return found[:n]
