"""Text renderings of cliques, states and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clique_text(clique="clique", sep: str = ",") -> Column:
    return F.array_join(clique, sep)


def format_state(clique="clique", ext="ext") -> Column:
    """``[a, b]->[x, y]``"""
    return F.concat(
        F.lit("["), F.array_join(clique, ", "), F.lit("]->["), F.array_join(ext, ", "), F.lit("]")
    )


def format_report(histogram: DataFrame) -> DataFrame:
    """One text line per row of a ``(clique_size, n_cliques)`` table."""
    line = F.concat(
        F.lit("Cliques of size "), F.col("clique_size").cast("string"),
        F.lit(" => "), F.format_number("n_cliques", 0),
    )
    return histogram.select("clique_size", line.alias("line"))


def format_info(info: DataFrame) -> DataFrame:
    """The graph summary as display strings: grouped counts, two-decimal averages."""
    return info.select(
        F.format_number("n_vertices", 0).alias("n_vertices"),
        F.format_number("n_edges", 0).alias("n_edges"),
        F.format_number("edges_per_vertex", 2).alias("edges_per_vertex"),
        F.format_number("avg_degree", 2).alias("avg_degree"),
    )
