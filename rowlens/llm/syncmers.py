"""Document fingerprints from closed syncmers.

Of the k-byte strings of a text, those count whose least s-byte string (by a
hash) is their first or last. Whether one does depends on its own bytes only,
so an edit changes the choice nowhere but in the strings that it touches, and
a text keeps its anchors wherever it is moved. ``anchors`` returns them with
their positions, and ``longest`` matches two texts by position: anchors that
they share at one and the same distance make a common stretch, however much
longer either text is.

For a fingerprint of fixed size the anchors' hashes are dealt to ``BINS`` bins;
it keeps 16 bits of each bin's least hash, in hexadecimal, 0000 for an empty
bin. The share of equal bins estimates the Jaccard index J of two texts'
anchors; the likeness returned is 2 J / (1 + J), the share of the anchors that
the two have in common.

``neighbours`` also fingerprints each text after an edit that needs the next
document by doc_id. Documents are dealt out once by ranges of doc_id whose
first documents are known, and the first of each range goes to the one before
it, too. There are as many ranges as ``PART_BYTES`` each makes of the texts.

Defined cases: a null text counts as empty; the empty text's fingerprint has
only empty bins, and is like itself (1) and unlike any other (0); a text below k
bytes is one anchor; null doc_ids come first and rows with equal doc_ids are
ordered by a hash of the text; one document is its own next; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import cut, discard, fields, partitions, ship, sliced, text_of
from rowlens.llm.rolling import Prefix, mix, sliding_min

K, S, BINS = 12, 4, 128
CHUNK = 1 << 20
#: Bytes of the texts that one task pairs with their next.
PART_BYTES = 32 << 20
_BIN_BITS, _VALUE_BITS = 7, 40

#: Number of the text, byte offset in it, and hash, of each anchor, ascending by the first two.
Anchors = tuple[np.ndarray, np.ndarray, np.ndarray]


def anchors_of(texts: list[bytes]) -> Anchors:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    prefix = Prefix(np.frombuffer(b"".join(texts), np.uint8))
    own = np.repeat(np.arange(len(texts)), sizes)
    inner, whole = prefix.all(S), prefix.all(K)
    least = sliding_min(inner, K - S + 1)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :][: len(least)] == least))
    at = at[at + K <= bounds[1:][own[at]]]
    doc, value = own[at], whole[at]
    # texts without such a string: below K bytes all of it, else the least k-byte string
    none = np.flatnonzero((np.bincount(doc, minlength=len(texts)) == 0) & (sizes > 0))
    if len(none):
        best = np.array([bounds[d] if sizes[d] < K else bounds[d] + whole[bounds[d] : bounds[d + 1] - K + 1].argmin() for d in none.tolist()])
        more = [prefix.of(bounds[[d]], bounds[[d + 1]])[0] if sizes[d] < K else whole[i] for d, i in zip(none.tolist(), best.tolist())]
        doc, at, value = np.concatenate([doc, none]), np.concatenate([at, best]), np.concatenate([value, np.array(more, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, at, value = doc[order], at[order], value[order]
    return doc, at - bounds[doc], value


def _printed(found: Anchors, n: int) -> np.ndarray:
    """One row of BINS 16-bit numbers per text, 0 for an empty bin."""
    doc, _, value = found
    bins = doc.astype(np.uint64) << np.uint64(_BIN_BITS) | value >> np.uint64(64 - _BIN_BITS)
    low = np.uint64((1 << _VALUE_BITS) - 1)
    keys = np.sort(bins << np.uint64(_VALUE_BITS) | value & low)
    bins = keys >> np.uint64(_VALUE_BITS)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(keys) else np.zeros(0, int)
    out = np.zeros(n * BINS, np.uint16)
    out[bins[first].astype(np.int64)] = ((keys[first] & low) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out.reshape(-1, BINS)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of BINS 16-bit numbers per text, 0 for an empty bin."""
    return np.concatenate([np.zeros((0, BINS), np.uint16), *(_printed(anchors_of(texts[i:j]), j - i) for i, j in _slices(texts))])


def _compared(old: list[bytes], new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts and of as many others, and longest of each two."""
    parts = []
    for i, j in _slices([a + b for a, b in zip(old, new)]):
        a, b = anchors_of(old[i:j]), anchors_of(new[i:j])
        parts.append((_printed(a, j - i), _printed(b, j - i), longest([len(t) for t in old[i:j]], a, b)))
    own, other, same = (np.concatenate(x) for x in zip(*parts))
    return own, other, same


def _numbered(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A key of each anchor: its text, its hash, and how often the text had it before."""
    order = np.lexsort((value, doc))  # stable: by position where these are equal
    d, v = doc[order], value[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.zeros(0, bool)
    places = np.arange(len(d))
    nth = places - np.maximum.accumulate(np.where(new, places, 0))
    key = np.empty(len(d), np.uint64)
    key[order] = mix(v + mix(d.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64)))
    return key


def longest(sizes: list[int], a: Anchors, b: Anchors) -> np.ndarray:
    """Of texts, pair by pair, the bytes of the longest common stretch that their anchors show; sizes: the first ones'.

    The nth occurrence of an anchor in one text is compared with the nth in the
    other. Neighbouring anchors of a that b has at one distance make a stretch.
    """
    out = np.zeros(len(sizes), np.int64)
    (doc, at, value), (other, place, theirs) = a, b
    _, i, j = np.intersect1d(_numbered(doc, value), _numbered(other, theirs), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, shift = i[order], (place[j] - at[i])[order]
    if not len(i):
        return out
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (shift[1:] != shift[:-1]) | (doc[i[1:]] != doc[i[:-1]])]))
    last = np.concatenate([new[1:], [len(i)]]) - 1
    own = doc[i[new]]
    np.maximum.at(out, own, np.minimum(at[i[last]] + K, np.array(sizes)[own]) - at[i[new]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints, row by row: 0 to 1."""
    union = ((a > 0) | (b > 0)).sum(1)
    j = ((a == b) & (a > 0)).sum(1) / np.maximum(union, 1)
    return np.where(union == 0, 1.0, 2 * j / (1 + j))


def text_form(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        for i, j in _slices(texts):
            doc, at, value = anchors_of(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc + i)), pa.array(at, pa.int64()), pa.array(value.view(np.int64))], names=["doc_id", "at", "hash"]
            )


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, at (byte offset), hash: one row per anchor of a document; the empty text has none."""
    ship(docs.sparkSession)
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_anchored, "doc_id long, at long, hash long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: part, extra, doc_id, text, sorted; each part ends with the rows of the next one's first document."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        """rows: the last of them is only the one that follows."""
        texts = [t for _, _, _, t in rows]
        new = [edited(t, u) for t, u in zip(texts, texts[1:])]
        raw, old = [t.encode() for t in new], [t.encode() for t in texts]
        own, other, same = _compared(old[:-1], raw)
        following = np.concatenate([own[1:], fingerprints(old[-1:])])
        cols = (
            pa.array([r[2] for r in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            pa.array([text_form(x) for x in own]),
            pa.array([text_form(x) for x in other]),
            pa.array(likeness(own, other)),
            pa.array(likeness(own, following)),
            pa.array(same),
        )
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_bytes"]
        return pa.RecordBatch.from_arrays(list(cols), names=names)

    rows: list[tuple] = []
    size = 0
    for batch in sliced(batches, 3):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[-1][0]:  # a new part
                if len(rows) > 1:
                    yield done(rows)
                rows, size = [], 0
            if row[1] and rows and rows[-1][1]:
                continue  # rows equal to the one that follows
            rows.append(row)
            size += len(row[3])
            if size > CHUNK and len(rows) > 1:
                yield done(rows)
                rows, size = rows[-1:], len(row[3])
    if len(rows) > 1:
        yield done(rows)


_NO_ID = -(1 << 63)


def _order(doc_id: Column, tie: Column) -> tuple[Column, Column, Column]:
    """Whole numbers by which rows are in order: null doc_ids first."""
    return F.coalesce(doc_id, F.lit(_NO_ID)), doc_id.isNotNull().cast("long"), tie


def _part(bounds: list[np.ndarray], row: tuple[Column, Column, Column]) -> Column:
    """Number of the last bound that is not above the row, by bisection; the first bound is the least row."""
    arrays = [F.lit(b) for b in bounds]
    n = len(bounds[0])

    def step(x: Column, _: Column) -> Column:
        middle = F.shiftright(x["lo"] + x["hi"] + 1, 1)
        (a, b, c), (d, e, f) = (a[middle] for a in arrays), row
        reached = (a < d) | ((a == d) & ((b < e) | ((b == e) & (c <= f))))
        return F.struct(F.when(reached, middle).otherwise(x["lo"]).alias("lo"), F.when(reached, x["hi"]).otherwise(F.greatest(middle - 1, x["lo"])).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), begin, step, lambda x: x["lo"])


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_bytes; one row per document.

    same_bytes: of the longest stretch that a text and its edited text have in
    common, as their anchors' positions show it.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).alias("text"))
    ids = cut(rows.select(*[c.alias(n) for c, n in zip(_order(F.col("doc_id"), F.col("tie")), "abc")], F.octet_length("text").cast("long").alias("size")))
    n = max(3 * partitions(spark), (ids.agg(F.sum("size")).first()[0] or 0) // PART_BYTES + 1)
    dealt = ids.select("a", "b", "c").repartitionByRange(n, "a", "b", "c")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("a", "b", "c")).alias("m")).collect()  # n rows
    discard(ids)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_bytes long"
    if not least:
        return spark.createDataFrame([], schema)
    firsts = sorted(tuple(r["m"]) for r in least)
    bounds = [np.array(x, np.int64) for x in zip(*firsts)]
    row = _order(F.col("doc_id"), F.col("tie"))
    rows = rows.withColumn("part", _part(bounds, row))
    first = F.lit(True)
    for b, x in zip(bounds, row):
        first = first & (F.lit(b)[F.col("part")] == x)
    before = F.when(F.col("part") == 0, len(firsts) - 1).otherwise(F.col("part") - 1)
    here, there = (F.struct(p.alias("part"), F.lit(extra).alias("extra")) for p, extra in ((F.col("part"), False), (before, True)))
    rows = rows.withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("to.part", "to.extra", "doc_id", "tie", "text")
    rows = rows.repartitionById(len(firsts), "part").sortWithinPartitions("part", "extra", "doc_id", "tie").select("part", "extra", "doc_id", "text")
    return rows.mapInArrow(_pairs, schema)
