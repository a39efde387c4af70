"""Ordinals of Parquet rows and positions in a view, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.model import RID


#: Files whose counts the driver keeps.
MOST_FILES = 100_000


def file_counts(df: DataFrame) -> list[tuple[str, int]] | None:
    """Of a Parquet source of several files, its files in order and their rows; None where there are too many."""
    n = len(df.inputFiles())
    if not 1 < n <= MOST_FILES:
        return None
    files = df.select(F.col("_metadata.file_path").alias("_f")).groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    return sorted((r["_f"], r["_n"]) for r in files.collect())  # a row per file


def rows_between(df: DataFrame, counts: list[tuple[str, int]], start: int, end: int) -> DataFrame | None:
    """df's rows with these ordinals and RID, from the files that hold them; None where that is more than one."""
    before = 0
    for path, n in counts:
        if before <= start and end <= before + n:
            index = F.col("_metadata.row_index")
            one = df.sparkSession.read.schema(df.schema).parquet(path).select("*", (index + before).alias(RID))
            return one.filter((index >= start - before) & (index < end - before))
        before += n
    return None


def by_row_index(df: DataFrame) -> DataFrame:
    """df of Parquet with RID: the row index of a file, after the rows of the files before it."""
    index = F.col("_metadata.row_index")
    if len(df.inputFiles()) <= 1:
        return df.select("*", index.alias(RID))  # filters on it reach the scan
    raw = df.select("*", F.col("_metadata.file_path").alias("_f"), index.alias("_i"))
    files = df.select(F.col("_metadata.file_path").alias("_f")).groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as files
    files = files.select("_f", F.coalesce(before, F.lit(0)).alias("_before"))
    return raw.join(files, "_f").withColumn(RID, F.col("_i") + F.col("_before")).drop("_f", "_i", "_before")


def positions(df: DataFrame, order: list, name: str = "view_pos", columns: list | None = None) -> DataFrame:
    """df in that order with its positions from 0, without one task that sees all rows.

    The rows are range-partitioned and sorted once, and kept until ``release``;
    the tasks' row counts, as many as tasks, then shift the numbers that Spark
    gives within them.
    """
    from pyspark import StorageLevel

    columns = columns or [F.col(c) for c in df.columns]
    raw = df.orderBy(*order).select(*columns, F.monotonically_increasing_id().alias("_m")).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_m", 33)
    counts = raw.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    out = raw.withColumn("_p", part).join(counts, "_p")
    return keeping(out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_before"), raw)


def keeping(df: DataFrame, kept: DataFrame) -> DataFrame:
    """df, which reads what another keeps."""
    df._rowlens_kept = getattr(kept, "_rowlens_kept", kept)
    return df


def release(df: DataFrame) -> None:
    """Gives up what a frame kept, once it has been read."""
    kept = getattr(df, "_rowlens_kept", None)
    if kept is not None:
        kept.unpersist()
