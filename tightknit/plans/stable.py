"""Intermediate tables that outlive a lost executor.

``stable(df)`` writes ``df`` as parquet into the shared folder named by
``spark.checkpoint.dir`` and returns a scan of it. Compared with a cached
DataFrame the scan survives executor loss without recomputation, cuts the
lineage of iterative plans, and gives the planner a file size to decide on a
broadcast. It also makes both sides of a later join plain shuffles, which is
what the adaptive skew join needs in order to split a hub vertex.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Largest table that may be broadcast, by its measured in-memory size.
MAX_BROADCAST_BYTES = 256 << 20

# Longest neighbor list kept in one row (1 MiB of ids).
LIST_BOUND = 1 << 17

_own_folders: dict[str, str] = {}


def table_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    sc = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir")
        or sc.getCheckpointDir()  # set by the program itself
    )
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError(
                "spark.checkpoint.dir is not set: it must name a folder all executors can reach"
            )
        shared = _own_folders.get(sc.applicationId)
        if shared is None:
            shared = _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="tightknit-")
    return f"{shared.rstrip('/')}/tightknit-{sc.applicationId}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable_by(df: DataFrame, column: str) -> DataFrame:
    """``stable(df)`` with a folder for each value of ``column``: a filter on it reads no other."""
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stable(df)`` and integer aggregates over its rows, taken in the same pass.

    A retried task can be counted twice: the measures are upper bounds, exact at
    zero, and serve to size things, never as results.
    """
    seen = Observation()
    aggregates = [F.coalesce(measure, F.lit(0)).alias(name) for name, measure in measures.items()]
    return stable(df.observe(seen, *aggregates)), seen.get


def fetch_side(table: DataFrame, n_bytes: int, limit: int) -> DataFrame:
    """``table`` as the side of an equi-join that rows are looked up in.

    Broadcast if its measured in-memory size ``n_bytes`` is within ``limit``;
    otherwise a shuffled sort-merge join, which spills and which adaptive
    execution splits at hub keys. Without a hint the planner could broadcast the
    other side, whose size it underestimates: an explode counts as one row out.
    """
    if n_bytes <= limit:
        return F.broadcast(table)
    return table.hint("merge")


def list_bytes(length: str) -> Column:
    """In-memory size of a table of id lists: 8 bytes per id and 64 beside them per row."""
    return F.sum(F.col(length).cast("bigint") * 8 + 64)


def drop_table(table: DataFrame) -> None:
    """Delete the table that ``stable`` has written; what reads it ends here."""
    spark = table.sparkSession
    folder = table_folder(spark).removeprefix("file://").removeprefix("file:")
    for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if f"{folder}/" not in path:
            raise ValueError(f"{path} is no stored table of this application")
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results read from them end here."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
