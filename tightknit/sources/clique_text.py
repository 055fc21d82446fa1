"""Clique text files: delimited k-cliques and ``anchor<TAB>members`` maximal cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tightknit.operators.kclique import expand_compact
from tightknit.sources.output import run_path


def maximal_line(anchor="anchor", clique="clique"):
    return F.concat_ws("\t", F.col(anchor).cast("string"), F.array_join(clique, " "))


def write_cliques(
    cliques: DataFrame, path: str, sep: str = ",", compression: str | None = "gzip",
    run_id: str | None = None, num_partitions: int | None = None,
) -> str:
    """One clique per line, members joined by ``sep``; as many files as ``num_partitions`` says.

    A compact listing ``(prefix, ext)`` is written out clique by clique.
    """
    target = run_path(path, run_id)
    if "prefix" in cliques.columns:
        cliques = expand_compact(cliques)
    lines = cliques.select(F.array_join("clique", sep).alias("value"))
    lines = lines.repartition(num_partitions) if num_partitions else lines
    lines.write.option("compression", compression or "none").text(target)
    return target


def write_maximal(
    cliques: DataFrame, path: str, compression: str | None = None, run_id: str | None = None,
    num_partitions: int | None = None,
) -> str:
    """``anchor<TAB>v1 v2 ...`` per maximal clique; as many files as ``num_partitions`` says."""
    target = run_path(path, run_id)
    lines = cliques.select(maximal_line().alias("value"))
    lines = lines.repartition(num_partitions) if num_partitions else lines
    lines.write.option("compression", compression or "none").text(target)
    return target


def read_cliques(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """``(clique, clique_size, anchor)`` from delimited lines."""
    members = F.split("value", f"\\Q{sep}\\E")
    cliques = spark.read.text(path).select(members.cast("array<bigint>").alias("clique"))
    return cliques.select("clique", F.size("clique").alias("clique_size"), F.array_min("clique").alias("anchor"))


def read_maximal(spark: SparkSession, path) -> DataFrame:
    """``(clique, clique_size, anchor)`` from ``anchor<TAB>members`` lines."""
    halves = F.split("value", "\t")
    rows = spark.read.text(path).select(
        halves[0].cast("bigint").alias("anchor"),
        F.split(halves[1], " ").cast("array<bigint>").alias("clique"),
    )
    return rows.select("clique", F.size("clique").alias("clique_size"), "anchor")
