"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are, for every run of ``w`` neighboring k-grams of words,
those k-grams whose hash is the smallest of the run. Two texts that share a
span of ``k + w - 1`` words share all k-grams of one run and so a fingerprint at
the same place of the span: no shared span is missed. A shared fingerprint is
extended word by word to both sides, words themselves being compared, and counts
if what is equal reaches the span's length.

The fingerprints of the benchmark are looked up in blocks of bounded size, each
broadcast; only documents' fingerprints that some item has are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tightknit.plans.stable import stable

#: Words of a window, and the longest k-gram that is hashed.
SPAN, K = 13, 8

#: Benchmark fingerprints broadcast at once: 8 bytes each in the table, 32 MiB built.
BLOCK = 1 << 20

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words of a text: ASCII letters and digits and everything beyond ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN_WORDS), "")


def _fingerprints(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` with its column ``w`` of words, and an array ``found`` of the fingerprints for ``span``.

    Each is ``(span, hash, pos, left, near)``: the k-gram's place, and the words from ``left``
    before it to as many behind it as a span can reach.
    """
    k = min(K, span)
    around = span - k
    n = F.size("w") - (k - 1)

    def hash_at(i: Column) -> Column:
        return F.xxhash64(F.lit(span), F.slice("w", i, k))

    def marked(i: Column, value: Column) -> Column:
        left = F.least(i - 1, F.lit(around))
        return F.struct(
            F.lit(span).alias("span"),
            value.alias("hash"),
            (i - 1).alias("pos"),
            left.alias("left"),
            F.slice("w", i - left, left + span).alias("near"),
        )

    places = F.when(n > around, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    if around == 0:
        # Each place is hashed where it is marked: an array of hashes used in one place only would be computed anew for each.
        return rows.withColumn("found", F.transform(places, lambda i: marked(i, hash_at(i))))
    hashed = rows.withColumn("g", F.transform(places, hash_at))
    runs = F.when(n > around, F.sequence(F.lit(0), n - around - 1)).otherwise(F.array().cast("array<int>"))
    least = hashed.withColumn("m", F.transform(runs, lambda j: F.least(*(F.get("g", j + t) for t in range(around + 1)))))
    # The smallest of some run that holds it: as large as the largest of those runs' minima.
    chosen = F.filter(
        places, lambda i: F.get("g", i - 1) == F.greatest(*(F.get("m", i - 1 - t) for t in range(around + 1)))
    )
    return least.withColumn("i", chosen).withColumn("found", F.transform("i", lambda i: marked(i, F.get("g", i - 1)))).drop("g", "m", "i")


def _exploded(rows: DataFrame, spans: list[int], *keys: str) -> DataFrame:
    parts = []
    for span in spans:
        rows = _fingerprints(rows, span).withColumnRenamed("found", f"found{span}")
        parts.append(f"found{span}")
    return rows.select(*keys, F.inline(F.concat(*parts)))


def matches(docs: DataFrame, items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Where documents hold windows of items.

    ``docs`` has ``key`` columns ``doc_id, version`` and words ``w``; ``items`` has ``item_id, w``.
    Returns a stored table ``doc_id, version, start, stop, context`` of equal stretches of
    words, and ``context, item_id``: the items that hold a stretch.
    """
    spark = docs.sparkSession
    items = items.where(F.size("w") > 0).withColumn("own", F.least(F.size("w"), F.lit(span)))
    # At most ``span`` different values.
    spans = sorted(r.own for r in items.select("own").distinct().collect())
    if not spans:
        none = spark.createDataFrame([], "doc_id bigint, version bigint, start int, stop int, context string")
        return none, spark.createDataFrame([], "context string, item_id string")
    of_items = reduce(
        DataFrame.unionByName,
        (_exploded(items.where(F.col("own") == s).select("item_id", "w"), [s], "item_id") for s in spans),
    )
    # Items that agree around a fingerprint share one row to extend against.
    context = F.md5(F.concat_ws(" ", "span", "left", F.concat_ws(" ", "near")))
    of_items = stable(of_items.withColumn("context", context))
    contexts = of_items.groupBy("context").agg(
        *(F.first(c).alias(b) for c, b in (("span", "span"), ("hash", "hash"), ("left", "left2"), ("near", "near2")))
    )
    hashes = of_items.select("hash").distinct()
    n_blocks = -(-hashes.count() // BLOCK)
    of_docs = _exploded(docs.select("doc_id", "version", "w"), spans, "doc_id", "version")
    known = reduce(
        DataFrame.unionByName,
        (
            of_docs.join(F.broadcast(hashes.where(F.pmod("hash", F.lit(n_blocks)) == b)), "hash", "left_semi")
            for b in range(n_blocks)
        ),
    )
    k = F.least("span", F.lit(K))

    def equal(mine: Column, theirs: Column) -> Column:
        return F.coalesce(F.get("near", mine) == F.get("near2", theirs), F.lit(False))

    left, right = F.lit(SPAN - K), F.lit(SPAN - K)
    for t in range(SPAN - K, 0, -1):
        left = F.when(equal(F.col("left") - t, F.col("left2") - t), left).otherwise(t - 1)
        right = F.when(equal(F.col("left") + k + (t - 1), F.col("left2") + k + (t - 1)), right).otherwise(t - 1)
    same = F.slice("near", F.col("left") + 1, k) == F.slice("near2", F.col("left2") + 1, k)
    hits = (
        known.join(contexts, ["span", "hash"])
        .where(same)
        .select("doc_id", "version", "pos", "span", "context", k.alias("k"), left.alias("l"), right.alias("r"))
        .where(F.col("l") + F.col("k") + F.col("r") >= F.col("span"))
        .select("doc_id", "version", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("k") + F.col("r")).alias("stop"), "context")
        .distinct()
    )
    return stable(hits), of_items.select("context", F.col("item_id").cast("string").alias("item_id")).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """How much of every document stands in benchmark items: ``doc_id, version, n_words, n_hit, items``.

    A word of a document is hit if it lies in an occurrence of a window of ``span`` words of an item, or of
    a whole item of fewer words. ``items`` lists the ids found, sorted as text. One row per row of ``docs``; ``version``
    is a hash of the text, by which rows that repeat an id with another text are told apart. Null
    texts have no words; items without words are never found, those without an id are not listed.
    """
    rows = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("version"),
        words(docs[text]).alias("w"),
    )
    items = benchmark.select(benchmark["item_id"], words(benchmark["text"]).alias("w"))
    hits, members = matches(rows, items, span)
    keys = ["doc_id", "version"]
    reached = F.max("stop").over(
        Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = (
        hits.select(*keys, "start", "stop")
        .distinct()
        .select(*keys, "stop", F.greatest("start", F.coalesce(reached, F.lit(0))).alias("start"))
        .groupBy(*keys)
        .agg(F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(0))).alias("n_hit"))
    )
    listed = (
        hits.select(*keys, "context")
        .distinct()
        .join(members, "context")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])

    found = covered.join(listed, same(covered, listed)).select(covered["doc_id"], covered["version"], "n_hit", "items")
    base = rows.select(*keys, F.size("w").cast("bigint").alias("n_words"))
    return base.join(found, same(base, found), "left").select(
        base["doc_id"],
        base["version"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = contamination(docs, benchmark, text=text, doc_id=doc_id).where(contaminated())
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct()
    version = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    same = docs[doc_id].cast("bigint").eqNullSafe(bad["bad_id"]) & (version == bad["bad_version"])
    return docs.join(bad.hint("merge"), same, "left_anti")
