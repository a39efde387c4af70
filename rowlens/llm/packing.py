"""Packing documents into token sequences: dominance reduction, then best fit.

Documents are tokenized where they are read. One longer than a sequence is cut
into pieces, all full but the first. What then has to be solved depends only
on how many pieces there are of each length, at most ``capacity`` numbers,
however large the corpus. Over these counts the reduction of Martello and Toth
fixes, again and again, sets of up to three lengths that dominate every other
set with the longest of them; what is left goes best fit, longest first. The
plan is a bounded table of patterns with multiplicities; each piece finds its
sequence by its rank among the pieces of its length. Where the documents have
an order, ranks follow it, and the sequences are numbered by their first piece
in it.

Defined cases: a null or empty text is one piece, the end id alone; equal rows
are packed each on its own; a very long text is tokenized whole; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import cut, fields, ship
from rowlens.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2

Pattern = tuple[int, ...]


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with multiplicities, and the counts that are left.

    For a length s with room r beside it, a set dominates all others with s if
    - nothing fits into r: {s};
    - a length r exists, which takes all that any others could: {s, r};
    - no two others fit into r: {s, the longest that fits};
    - no three others fit into r, and with k the longest that fits and a the
      longest that fits beside both, a is at least the shorter of any two that
      fit into r: {s, k, a}.
    """
    left = {s: n for s, n in counts.items() if n}
    fixed: list[tuple[Pattern, int]] = []

    def fix(*lengths: int) -> None:
        need = Counter(lengths)
        n = min(left[s] // k for s, k in need.items())
        fixed.append((tuple(sorted(lengths, reverse=True)), n))
        for s, k in need.items():
            left[s] -= k * n
            if not left[s]:
                del left[s]

    def dominating(s: int) -> Pattern | None:
        room = capacity - s
        others = sorted(x for x in left if x <= room and left[x] > (x == s))
        if not others:
            return (s,)
        have = {x: left[x] - (x == s) for x in others}
        if room in have:
            return s, room
        few: list[int] = []  # the three shortest
        for x in others:
            few += [x] * min(have[x], 3 - len(few))
            if len(few) == 3:
                break
        longest = others[-1]
        if len(few) < 2 or few[0] + few[1] > room:
            return s, longest
        if len(few) < 3 or sum(few) > room:
            have[longest] -= 1
            beside = [x for x in others if have[x] and x + longest <= room]
            have[longest] += 1
            pairs = [x for i, x in enumerate(others) if x + (x if have[x] > 1 else others[i + 1] if i + 1 < len(others) else room) <= room]
            if beside and beside[-1] >= max(pairs, default=0):
                return s, longest, beside[-1]
        return None

    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while s in left and (found := dominating(s)):
                fix(*found)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, many equal sequences at a time."""
    open_: dict[int, Counter[Pattern]] = {}
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(pattern)
        if room:
            open_.setdefault(room, Counter())[pattern] += n
        else:
            done.append((pattern, n))

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                pattern, m = (), n
            else:
                pattern, m = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
            k = (room or capacity) // s  # the fullest one takes the next, too
            whole = min(m, n // k)
            if whole:
                put(pattern + (s,) * k, whole)
            n, m = n - whole * k, m - whole
            if m and 0 < n < k:
                put(pattern + (s,) * n, 1)
                n, m = 0, m - 1
            if m and pattern:
                put(pattern, m)
    return done + [(p, n) for patterns in open_.values() for p, n in patterns.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that use each length as often as counted."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def segments(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, list[int], list[int], list[int], list[int]]]:
    """By length: from which rank, first sequence, places in one sequence, offset of the first place."""
    used: Counter[int] = Counter()
    out: dict[int, tuple[list[int], ...]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            for col, x in zip(out.setdefault(s, ([], [], [], [])), (used[s], sequence, k, offset)):
                col.append(x)
            used[s] += k * n
            offset += k * s
        sequence += n
    return [(s, *cols) for s, cols in out.items()]


def _cutter(path: str, keeps_spaces: bool, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            places = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)] or [[part] * len(batch), [0] * len(batch)]
            for doc_id, group, place, ids in zip(batch.column(0).to_pylist(), *places, encoder(path, keeps_spaces).encode(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    size = first if start == 0 else capacity
                    for col, x in zip(cols, (doc_id, piece, start, size, zlib.crc32(ids[start : start + size].data), int(seen[size]), group, place)):
                        col.append(x)
                    seen[size] += 1
            doc, piece, *others = cols
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in others)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part", "place"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, keeps_spaces: bool = True, capacity: int = CAPACITY, end_id: int = END_ID, order: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every document; nth counts those of a length within a partition, part.

    order: columns of docs, a group of rows and the place within it, both whole
    numbers, by which the documents are ordered; then these are part and place,
    and nth means nothing.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long, place long"
    docs = fields(docs, "doc_id", "text", *(order or ()))
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), *[docs[c].cast("long") for c in order or ()])
    return cut(rows.mapInArrow(_cutter(tokenizer, keeps_spaces, capacity, end_id), schema))


def _numbered(found: DataFrame) -> DataFrame:
    """found with its sequences numbered by their first pieces in the documents' order."""
    spark = found.sparkSession
    found = cut(found)
    first = found.groupBy("sequence_id").agg(F.min(F.struct("part", "place", "doc_id", "piece")).alias("first"))
    first = cut(first.withColumn("part", F.col("first.part")))
    before, total = [], 0
    for r in first.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row per group of documents
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    number = first.withColumn("within", within).join(offsets, "part").select("sequence_id", (F.col("before") + F.col("within")).alias("number"))
    return found.join(number, "sequence_id").withColumn("sequence_id", F.col("number"))


def pack(
    docs: DataFrame, tokenizer: str, keeps_spaces: bool = True, capacity: int = CAPACITY, end_id: int = END_ID, order: tuple[str, str] | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece. order: as for pieces."""
    spark = docs.sparkSession
    cuts = pieces(docs, tokenizer, keeps_spaces, capacity, end_id, order)
    counts = cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.createDataFrame(
        segments(plan(totals, capacity)) or [(0, [0], [0], [1], [0])],
        "length long, ranks array<long>, sequences array<long>, places array<long>, offsets array<long>",
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if order:
        cuts = cuts.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("place", "doc_id", "piece")).cast("long") - 1)
    ranked = cuts.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    found = ranked.join(F.broadcast(table), "length")  # at most `capacity` rows, from a bounded plan
    found = found.withColumn("rank", F.col("before") + F.col("nth")).withColumn("i", F.expr("size(filter(ranks, x -> x <= rank))"))
    found = found.withColumn("k", F.expr("places[i - 1]")).withColumn("r", F.expr("rank - ranks[i - 1]"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = found.withColumn("sequence_id", F.expr("sequences[i - 1] + r div k")).withColumn("offset", F.expr("offsets[i - 1] + (r % k) * length"))
    return (_numbered(found.select(*columns, "part", "place")) if order else found).select(*columns)
