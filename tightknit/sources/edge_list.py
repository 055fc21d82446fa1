"""Edge lists: text files and table rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tightknit.functions.arrays import computed
from tightknit.operators.graph import orient, vertices_of
from tightknit.plans.stable import stable_by

MODES = ("PERMISSIVE", "FAILFAST")

TOO_FEW_TOKENS = "too few tokens"
NOT_NUMERIC = "not numeric"


class EdgeList(NamedTuple):
    """Canonical ``edges``, all ``vertices(v)`` named on a valid line, and ``rejects(line, reason)``."""

    edges: DataFrame
    vertices: DataFrame
    rejects: DataFrame


def tokens_of(line="value"):
    """Whitespace-separated tokens; leading and trailing blanks do not count."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def is_data(tokens="tokens"):
    """Neither blank nor a comment."""
    first = F.get(tokens, F.lit(0))
    return (first != "") & ~first.startswith("#")


def data_lines(lines: DataFrame) -> DataFrame:
    """``(line, tokens)`` of the lines that are neither blank nor comments."""
    rows = lines.select(F.col(lines.columns[0]).alias("line"))
    return computed(rows, ["line"], tokens=tokens_of("line")).filter(is_data())


def parse_pairs(lines: DataFrame) -> DataFrame:
    """``(line, src, dst, reason)`` per data line; ``reason`` is null on valid lines.

    The first two tokens are the endpoints, further tokens are ignored.
    """
    src = F.get("tokens", F.lit(0)).try_cast("bigint")
    dst = F.get("tokens", F.lit(1)).try_cast("bigint")
    reason = F.when(F.size("tokens") < 2, TOO_FEW_TOKENS).when(
        src.isNull() | dst.isNull(), NOT_NUMERIC
    )
    return data_lines(lines).select("line", src.alias("src"), dst.alias("dst"), reason.alias("reason"))


def checked_pairs(lines: DataFrame, mode: str) -> DataFrame:
    """``parse_pairs``; in ``FAILFAST`` mode a line with a non-numeric id fails the job."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    parsed = parse_pairs(lines)
    if mode == "PERMISSIVE":
        return parsed
    message = F.concat(F.lit("edge list line with a non-numeric id: "), F.col("line"))
    # Part of the endpoint itself, so that no column pruning can skip the check.
    checked = F.when(F.coalesce("reason", F.lit("")) != NOT_NUMERIC, F.col("src")).otherwise(
        F.raise_error(message).cast("bigint")
    )
    return parsed.withColumn("src", checked)


def parse_edge_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> EdgeList:
    """Parse a one-column DataFrame of text lines.

    Blank lines, ``#`` comments and lines of fewer than two tokens are skipped;
    the latter show up in the rejects. A line with a non-numeric id goes to the
    rejects in ``PERMISSIVE`` mode and fails the job in ``FAILFAST`` mode.
    """
    parsed = checked_pairs(lines, mode)
    valid = parsed.filter(F.coalesce("reason", F.lit("")) != TOO_FEW_TOKENS) if mode == "FAILFAST" else parsed.filter(F.col("reason").isNull())
    pairs = valid.select("src", "dst")
    rejects = parse_pairs(lines).filter(F.col("reason").isNotNull()).select("line", "reason")
    return EdgeList(orient(pairs), vertices_of(pairs), rejects)


def read_edge_list(spark: SparkSession, path, mode: str = "PERMISSIVE", stored: bool = False) -> EdgeList:
    """Read ``src dst [ignored...]`` text files (any compression Spark reads).

    Each of the three outputs scans the file when it is used. With ``stored`` one job scans it once and writes all three.
    """
    lines = spark.read.text(path)
    return store_edge_lines(lines, mode) if stored else parse_edge_lines(lines, mode)


def store_edge_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> EdgeList:
    """``parse_edge_lines`` as stored tables, from one scan, one shuffle and one write.

    Every line becomes its edge, its two vertices or its reject, each marked with its kind. Equal ones are counted
    together, before the shuffle and after it, and a table partitioned by kind takes them.
    """
    table = stable_by(edge_list_rows(lines, mode), "kind")
    edges = table.filter(F.col("kind") == "edge").select("src", "dst")
    vertices = table.filter(F.col("kind") == "vertex").select(F.col("src").alias("v"))
    rejects = table.filter(F.col("kind") == "reject").select("line", "reason", "n")
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))
    return EdgeList(edges, vertices, rejects.select("line", "reason", again).select("line", "reason"))


def edge_list_rows(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """``(kind, src, dst, line, reason, n)``: distinct edges, vertices (as ``src``) and rejects of the lines."""
    parsed = checked_pairs(lines, mode)

    def row(kind: str, src, dst, line, reason):
        columns = {"kind": F.lit(kind), "src": src, "dst": dst, "line": line, "reason": reason}
        return F.struct(*(column.alias(name) for name, column in columns.items()))

    no_id, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    src, dst = F.col("src"), F.col("dst")
    ends = [row("vertex", end, no_id, no_text, no_text) for end in (src, dst)]
    edge = row("edge", F.least(src, dst), F.greatest(src, dst), no_text, no_text)
    reject = row("reject", no_id, no_id, F.col("line"), F.col("reason"))
    # In FAILFAST mode the endpoints of a line that is not numeric are what stops the job, so they are read.
    rejected = F.col("reason").isNotNull() if mode == "PERMISSIVE" else F.coalesce("reason", F.lit("")) == TOO_FEW_TOKENS
    found = F.when(rejected, F.array(reject)).when(src == dst, F.array(ends[0])).otherwise(F.array(edge, *ends))
    rows = parsed.select(F.inline(found))
    return rows.groupBy("kind", "src", "dst", "line", "reason").agg(F.count(F.lit(1)).alias("n"))


def edges_from_pairs(table: DataFrame, src: str, dst: str) -> DataFrame:
    """Canonical edges of a table in which every row links two ids; null ids are dropped."""
    pairs = table.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))
    return orient(pairs)
