"""Exact deduplication with a heavy-hitter split.

Every document is reduced to the SHA-256 of its text without white space. A
Misra-Gries sketch of each partition finds the digests that may be frequent;
their exact counts and winners, at most ``counters`` rows, are broadcast, so
copies of a hot text are resolved where they are read. All other digests are
grouped by an ordinary shuffle, in which no digest is large; their winners are
written before they are joined, so that a task with a warm digest can be split.

Defined cases: a null text counts as empty, so empty, blank and null texts are
equal; a null doc_id loses ties against any other; rows that tie in length and
doc_id are told apart by an arbitrary row number, so that exactly one row of a
group stays; very long texts are hashed whole; an empty table gives an empty
result; further columns, whatever their names, are ignored by ``groups`` and
kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import cut, fields, plain, retain, ship

#: What [\x20\x09-\x0D] stands for.
BLANKS = " \t\n\x0b\x0c\r"
COUNTERS = 256


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(plain(text), BLANKS, ""), 256))


def points_of(text: Column) -> Column:
    return F.length(plain(text)).cast("long")


def _rank() -> Column:
    """Sorts the row that stays last: most code points, then the smallest doc_id, then the smallest row."""
    return F.struct(F.col("n_points"), F.bitwise_not(F.col("doc_id").cast("long")).alias("id_down"), F.bitwise_not(F.col("row")).alias("row_down"))


def shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries: down to so many counters, each low by at most total / (counters + 1)."""
    if len(counts) <= counters:
        return counts
    less = sorted(counts.values(), reverse=True)[counters]
    return {d: n - less for d, n in counts.items() if n > less}


def _sketcher(counters: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        for pdf in batches:
            for digest, n in pdf["digest"].value_counts(sort=False).items():
                counts[digest] = counts.get(digest, 0) + n
            counts = shrink(counts, counters)
        yield pd.DataFrame({"digest": list(counts), "low": list(counts.values())})

    return sketch


def frequent(digests: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """The digests whose summed sketch counts exceed total / (counters + 1): at most ``counters``.

    A sketch never counts too much, so no more digests can pass; and as it is
    low by total / (counters + 1) at most, each digest with twice that share
    of the rows passes.
    """
    sketches = digests.select("digest").mapInPandas(_sketcher(counters), "digest binary, low long")
    return sketches.groupBy("digest").agg(F.sum("low").alias("low")).filter(F.col("low") > total / (counters + 1)).select("digest")


def split(rows: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """The rows of frequent digests with their group's winner, and all others with theirs.

    rows: digest, n_points, doc_id, row. Adds top (of _rank) and group_size.
    """
    spark = rows.sparkSession
    ship(spark)
    best = [F.max(_rank()).alias("top"), F.count(F.lit(1)).alias("group_size")]
    total = rows.count()
    maybe = [x["digest"] for x in frequent(rows, total, counters).collect()]  # at most `counters` rows
    candidates = spark.createDataFrame([(bytes(d),) for d in maybe], "digest binary")
    verified = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*best)
    schema = verified.schema
    heavy = spark.createDataFrame(verified.filter("group_size > 1").collect(), schema)
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return hot, rest.join(cut(rest.groupBy("digest").agg(*best)), "digest")


def _rows(docs: DataFrame) -> DataFrame:
    docs = fields(docs, "doc_id", "text")
    return cut(docs.select("doc_id", digest_of(docs["text"]).alias("digest"), points_of(docs["text"]).alias("n_points"), F.monotonically_increasing_id().alias("row")))


def groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hot, rest = split(_rows(docs), counters)
    return hot.unionByName(rest).select(
        "doc_id",
        F.bitwise_not(F.col("top.id_down")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("top.row_down") == F.bitwise_not(F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    hot, rest = split(_rows(docs), counters)
    lost = hot.unionByName(rest).filter(F.col("group_size") > 1)
    lost = lost.select("doc_id", "digest", "n_points", (F.col("top.row_down") == F.bitwise_not(F.col("row"))).alias("stays"))
    marks = cut(lost.groupBy("doc_id", "digest", "n_points").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies")))
    return retain(docs, lambda c: {"doc_id": c("doc_id"), "digest": digest_of(c("text")), "n_points": points_of(c("text"))}, marks)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, doc_id AS keep_id, group_size FROM (
    SELECT text_sha256, doc_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY length(txt) DESC, doc_id) AS rn
    FROM t) WHERE rn = 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
