"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The text of a source is cut, in a seeded random order of its documents, into
blocks of ``block_chars`` code points. A source with ``w`` of ``W`` weight parts
gives its block j (from 0) the release time floor(j W / w) and the deadline
ceil((j + 1) W / w). Earliest deadline first over one period of W slots then
serves each source within less than one block of its weight at every slot, and
as weights are whole parts the schedule repeats: block j takes slot
(j div w) W + place[j mod w]. So the only sequential work is a fold over W
slots of one row; every document finds its slot by a join with that table.

A source that has run dry leaves its slots empty, so that the others keep their
proportions among themselves; no document is dropped or repeated.

Defined cases: a null source counts as the source ''; a null or empty text
takes no room and keeps its place in its source's order; sources that are not
in ``weights`` have ``default`` parts; rows with equal doc_ids are ordered by
length and a hash of their text; very long texts count whole, and the blocks
that they span belong to the slot of their first code point; an empty table
gives an empty result; further columns, whatever their names, are ignored, or
kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import aliased, partitions, plain

#: Production parameters: parts of the mixture by source; all others have one part.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2}
BLOCK_CHARS = 65_536
ROWS_PER_BUCKET = 20_000


def _weight_of(source: Column, weights: Mapping[str, int], default: int) -> Column:
    if any(int(w) != w or w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights must be whole numbers of parts from 1")
    known = [F.lit(x) for kv in weights.items() for x in kv]
    found = F.try_element_at(F.create_map(*known), source) if known else F.lit(None)
    return F.coalesce(found.cast("long"), F.lit(default).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """One period: source, weight, period, nth (of the source's blocks in it), place (slot in it).

    sources: source, weight; one row each. It becomes one row, folded over its slots.
    """
    one = sources.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("s"), F.sum("weight").alias("period"))
    picks = F.expr("""
      aggregate(sequence(0L, period - 1),
        named_struct('served', transform(s, x -> 0L), 'picks', cast(array() as array<int>)),
        (acc, t) -> element_at(transform(
          array(array_min(transform(s, (x, i) -> if(
            acc.served[i] * period div x.weight <= t and acc.served[i] < x.weight,
            named_struct('deadline', ((acc.served[i] + 1) * period + x.weight - 1) div x.weight, 'i', i), null)))),
          c -> named_struct('served', transform(acc.served, (n, i) -> n + if(i = c.i, 1L, 0L)),
                            'picks', concat(acc.picks, array(c.i)))), 1),
        acc -> acc.picks)""")
    slots = one.filter("period > 0").select("s", "period", F.posexplode(picks).alias("place", "i"))
    slots = slots.select(F.expr("s[i].source").alias("source"), F.expr("s[i].weight").alias("weight"), "period", "place")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1
    return slots.select("source", "weight", "period", nth.cast("long").alias("nth"), F.col("place").cast("long").alias("place"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, int] = WEIGHTS,
    default: int = 1,
    block_chars: int = BLOCK_CHARS,
    seed: int = 0,
    keep: bool = False,
) -> DataFrame:
    """Each document's place: doc_id, source, amount, start, block, slot.

    start counts the code points before it in its source. Ordering by slot,
    then start, then doc_id reads the mixture. keep: return the columns of
    docs, in that order.
    """
    spark = docs.sparkSession
    given, column = aliased(docs)
    text = plain(column("text"))
    rows = given.select(
        column("doc_id").alias("doc_id"),
        plain(column("source")).alias("source"),
        F.length(text).cast("long").alias("amount"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column("doc_id").cast("string"), F.lit("null")))).alias("key"),
        F.xxhash64(text).alias("tie"),
        *([F.struct(*given.columns).alias("own")] if keep else []),
    )
    buckets = max(partitions(spark), docs.count() // ROWS_PER_BUCKET + 1)
    # The first 32 bits of the key give the bucket, so buckets follow the order of the keys.
    bucket = F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) as long) * {buckets}L div 4294967296L")
    rows = rows.withColumn("bucket", bucket)
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("amount").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_bucket.select("source", "bucket", before.alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "amount", "tie")
    within = F.coalesce(F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("within", within).join(offsets, ["source", "bucket"])
    start = F.col("before") + F.col("within")
    placed = placed.withColumn("start", start).withColumn("block", F.expr(f"start div {int(block_chars)}L"))
    names = per_bucket.select("source").distinct()
    plan = schedule(names.select("source", _weight_of(F.col("source"), weights, default).alias("weight")))
    placed = placed.withColumn("parts", _weight_of(F.col("source"), weights, default)).withColumn("nth", F.expr("block % parts"))
    out = placed.join(plan, ["source", "nth"]).withColumn("slot", F.expr("(block div weight) * period + place"))
    if keep:
        return out.orderBy("slot", "start", "doc_id").select("own.*").toDF(*docs.columns)
    return out.select("doc_id", "source", "amount", "start", "block", "slot")


def written_order(mixed: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """mixed as read from the files that ``mix`` with keep was written to, with its rows' places, and the names of these two columns.

    A sorted result is written in files numbered by its order, each in order;
    but they are read in splits of any order. So a row's place is that in its
    file, in groups of at most ROWS_PER_BUCKET rows.
    """
    number = "coalesce(try_cast(regexp_extract(_metadata.file_name, '{}', 1) as bigint), 0)"
    file = f"shiftleft({number.format('^part-([0-9]+)-')}, 10) + {number.format('-c([0-9]+)[.]')}"
    group = F.expr(f"shiftleft({file}, 29) + _metadata.row_index div {ROWS_PER_BUCKET}L")
    return mixed.withColumns({"_group": group, "_place": F.col("_metadata.row_index")}), ("_group", "_place")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS amount,
         md5('0:' || doc_id::VARCHAR) AS key FROM documents),
p AS (
  SELECT doc_id, source, amount,
         coalesce(sum(amount) OVER (PARTITION BY source ORDER BY key, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
s AS (
  SELECT source, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1 END::BIGINT AS w,
         row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM d)),
arr AS (SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS period FROM s),
edf(t, served, pick) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM arr
  UNION ALL
  SELECT t + 1, list_transform(served, lambda x, i: x + CASE WHEN i = pick2 THEN 1 ELSE 0 END), pick2 FROM (
    SELECT t, served, (list_min(list_filter(list_transform(ws, lambda w, i:
      CASE WHEN served[i] < w AND (served[i] * period) // w <= t + 1
           THEN (((served[i] + 1) * period + w - 1) // w) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000)::BIGINT AS pick2
    FROM edf, arr WHERE t + 1 < period)),
sched AS (
  SELECT s.source, s.w, edf.t AS place, row_number() OVER (PARTITION BY s.source ORDER BY edf.t) - 1 AS nth
  FROM edf JOIN s ON s.i = edf.pick WHERE edf.t >= 0)
SELECT p.doc_id, p.source, p.amount, p.start, p.start // {BLOCK_CHARS} AS block,
       ((p.start // {BLOCK_CHARS}) // sched.w) * arr.period + sched.place AS slot
FROM p JOIN sched ON sched.source = p.source AND sched.nth = (p.start // {BLOCK_CHARS}) % sched.w, arr
"""
