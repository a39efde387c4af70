"""N-gram Jaccard join: MinHash bands find pairs, full n-gram sets verify them.

A document is the set of its n-grams of words (runs of letters, digits and
underscores, in lower case); one with fewer words is one n-gram of them all.

1. Documents with equal sets form a class, and go on as one.
2. Bands of MinHash values, as many as the recall asked for needs at the
   threshold, are shuffled by their hash. Every class in a bucket is tied to
   the bucket's least class, its hub, so a bucket of g gives g rows, not
   g (g - 1) / 2; two classes that share a bucket share a hub.
3. The classes tied to a hub meet in one task, or, if there are more than
   ``block`` or their sets hold more than ``MOST_GRAMS``, in tasks of two blocks
   each that together see each pair once that can be alike at all: sets whose
   sizes are too far apart never meet. There all pairs are verified on their
   full sets by matrix products, tile by tile, and a task returns for each
   class a count and one link to the group it is in: no row is made per pair.
   Where two classes share several hubs, the least counts them.
4. Groups are the connected components of the links, by alternating stars.

Defined cases: a null text counts as empty; documents without a word have equal
sets; rows with equal doc_ids are told apart by a hash of their text; a null
doc_id comes last when a group is named; very long texts are compared whole; an
empty table gives an empty result; ``groups`` ignores further columns, whatever
their names, and ``dedup`` keeps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import claim, cut, discard, fields, plain, retain, ship, sliced, text_of
from rowlens.llm.rolling import mix

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Classes that one task verifies against each other, their n-grams, and classes that one matrix product compares.
BLOCK, MOST_GRAMS, TILE = 512, 1 << 21, 512
#: A large hub's blocks grow with it up to so many classes, so that a text goes to no more than SPREAD tasks before that.
LARGEST, SPREAD = 2048, 64
_WORD = re.compile(r"\w+")
_MOST_WORDS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words; a worker keeps so many of them."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def bands(threshold: float, recall: float, rows: int) -> int:
    """So many bands of so many rows that a pair at the threshold is found with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """The hashed n-grams of a text, ascending, each once."""
    claim("words", _HASHES.clear)
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x *= _STEP
        x += h[i : len(h) - k + 1 + i]
    return np.unique(mix(x))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def sketch(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        values = np.multiply.outer(a, grams[i : i + 1024])
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _signer(words: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(n_bands * rows)
        salt = mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for batch in sliced(batches, 2):
            keys, sizes = [], []
            signs = np.zeros((len(batch), n_bands), np.uint64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                grams = ngrams(text, words)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                sizes.append(len(grams))
                values = sketch(grams, a, b).reshape(n_bands, rows)
                sign = salt.copy()
                for j in range(rows):
                    sign = mix(sign * _STEP + values[:, j])
                signs[i] = sign
            flat = pa.array(signs.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * n_bands + 1, n_bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "tie", "key", "n_grams", "bands"]
            )

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in sliced(batches, 1):
        z = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["class", "packed"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many numbers each of some sets shares with each of others, or of the same ones, itself left out.

    Numbers that no two sets can share are not looked at, the others in slices.
    """
    if right is None:
        flat, counts = np.unique(np.concatenate(left), return_counts=True)
        both, right = flat[counts > 1], left
    else:
        both = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (left, right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    sides = []
    for sets in (left, right):
        own, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        column = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        known = both[column] == flat
        order = np.argsort(column[known], kind="stable")
        sides.append((own[known][order], column[known][order]))
    width = 4096
    for lo in range(0, len(both), width):
        parts = []
        for n, (own, column) in zip(out.shape, sides):
            i, j = np.searchsorted(column, (lo, lo + width))
            x = np.zeros((n, min(width, len(both) - lo)), np.float32)
            x[own[i:j], column[i:j] - lo] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    if left is right:
        np.fill_diagonal(out, 0)
    return out


def _tiles(n: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            yield slice(i, i + TILE), slice(j, j + TILE)


def _alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets are alike: a symmetric matrix, false on its diagonal."""
    n = len(sets)
    near = np.zeros((n, n), bool)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        near[0, 1] = near[1, 0] = both >= threshold * (sizes.sum() - both) - 1e-6
        return near
    for a, b in _tiles(n):
        both = _overlaps(sets[a], None if a == b else sets[b])
        near[a, b] = both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-6
        near[b, a] = near[a, b].T
    np.fill_diagonal(near, False)
    return near


def _linked(near: np.ndarray) -> np.ndarray:
    """For each row its component's number; each row is looked at once."""
    label = np.full(len(near), -1, np.int64)
    for i in range(len(near)):
        if label[i] < 0:
            label[i], edge = i, np.array([i])
            while len(edge):
                reached = np.zeros(len(near), bool)
                for k in range(0, len(edge), TILE):
                    reached |= near[edge[k : k + TILE]].any(0)
                edge = np.flatnonzero(reached & (label < 0))
                label[edge] = i
    return label


def _verify(words: int, threshold: float):
    """Rows: hub, two blocks (l1, s1, l2, s2), class, side, copies, hubs, packed; sorted by hub and blocks. Returns class, links, to."""
    import zstandard

    def found(rows: list[tuple]) -> pa.RecordBatch:
        hub, blocks = rows[0][0], rows[0][1:5]
        z = zstandard.ZstdDecompressor()
        near = _alike([ngrams(z.decompress(r[9]).decode(), words) for r in rows], threshold)
        if blocks[:2] != blocks[2:]:  # two blocks: only pairs across
            side = np.array([r[6] for r in rows])
            near &= side[:, None] != side[None, :]
        said = np.flatnonzero(near.any(1))
        near = near[np.ix_(said, said)]
        ids = np.array([r[5] for r in rows], np.int64)[said]
        copies = np.array([r[7] for r in rows], np.int64)[said]
        label = _linked(near)
        to = np.full(len(said), np.iinfo(np.int64).max)
        np.minimum.at(to, label, ids)
        # pairs that meet at an earlier hub are counted there
        earlier = [np.array([h for h in rows[i][8] if h < hub], np.int64) for i in said.tolist()]
        if any(map(len, earlier)):
            for a, b in _tiles(len(said)):
                near[a, b] &= _overlaps(earlier[a], None if a == b else earlier[b]) == 0
                near[b, a] = near[a, b].T
        links = np.array([copies[row].sum() for row in near], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(to[label], pa.int64())], names=["class", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[:5] != rows[0][:5]:
                    yield found(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield found(rows)

    return run


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), by alternating large and small stars: node, least (the component's least node, which has no row)."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        discard(edges, least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u != v").distinct())
        discard(large, least)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), "least")
        before = now


def _signed(docs: DataFrame, words: int, threshold: float, recall: float, rows: int) -> DataFrame:
    ship(docs.sparkSession)
    docs = fields(docs, "doc_id", "text")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).alias("text"))
    n = bands(threshold, recall, rows)
    return cut(texts.mapInArrow(_signer(words, n, rows), "doc_id long, tie long, key binary, n_grams long, bands array<long>"))


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, tie, class (number of its set), copies, links (documents with other sets), group (least linked class)."""
    signed = _signed(docs, words, threshold, recall, rows)
    # The least doc_id stands for a class, null after all others.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    classes = signed.groupBy("key").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), "key", "copies", "n_grams", "one.doc_id", "one.tie", "bands"))
    members = classes.filter("n_grams > 0").select("class", F.explode("bands").alias("band"))
    buckets = cut(members.groupBy("band").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub"))
    ties = cut(members.join(buckets, "band").select("class", "hub").distinct())
    hubs = ties.groupBy("class").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))  # at most one per band
    # The texts of the classes that have a hub; of equal rows, one.
    asked = cut(hubs.join(classes.select("class", "copies", "n_grams", "doc_id", "tie"), "class"))
    given = fields(docs, "doc_id", "text")
    texts = given.select(given["doc_id"].cast("long").alias("_id"), F.xxhash64(text_of(given)).alias("_tie"), text_of(given).alias("text"))
    wanted = asked.select("class", "doc_id", "tie").hint("merge")  # grows with the corpus: never broadcast, however small a part is
    got = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")))
    packed = got.select("class", "text").mapInArrow(_packer, "class long, packed binary")
    packed = cut(packed.groupBy("class").agg(F.first("packed").alias("packed")))
    placed = _placed(ties, asked, threshold, block)
    work = placed.join(asked.select("class", "copies", "hubs").join(packed, "class"), "class")
    keys = ["hub", "l1", "s1", "l2", "s2"]
    work = work.select(*keys, "class", "side", "copies", "hubs", "packed").repartition(*keys).sortWithinPartitions(*keys)
    found = cut(work.mapInArrow(_verify(words, threshold), "class long, links long, to long"))
    discard(buckets, ties, asked, packed)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("to").alias("b")))
    out = classes.select("class", "key", "copies").join(links, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    out = cut(out.select("class", "key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "class").alias("group")))
    discard(classes, found)
    return signed.select("doc_id", "tie", "key", "n_grams").join(out, "key").select("doc_id", "tie", "n_grams", "class", "copies", "links", "group")


def _placed(ties: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Where each class is verified: hub, two blocks (l1, s1 and l2, s2), class, side (which of the two).

    A set that is ``threshold`` like another has at least that share of its
    size. So with levels that grow by 1 / threshold, only sets of one level or
    of neighbouring levels can be alike. A level has as many blocks as its
    classes and n-grams need.
    """
    level = F.floor(F.log(F.col("n_grams").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col("n_grams").cast("int")
    tied = ties.join(classes.select("class", "n_grams"), "class").select("hub", "class", "n_grams", level.alias("level"))
    levels = tied.groupBy("hub", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    hubs = levels.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.collect_list(F.struct("level", "n", "grams")).alias("levels"))
    half = max(1, block // 2)
    size = F.least(F.greatest(F.col("n") / SPREAD, F.lit(half)), F.lit(max(half, LARGEST)))
    subs = F.transform("levels", lambda x: F.struct(x["level"], F.greatest(F.ceil(x["n"] / size), F.ceil(x["grams"] / (MOST_GRAMS // 2))).cast("int")))
    hubs = hubs.select("hub", ((F.col("n") <= block) & (F.col("grams") <= MOST_GRAMS)).alias("small"), F.map_from_entries(subs).alias("subs"))
    tied = tied.join(cut(hubs), "hub").withColumn("sub", F.pmod(F.xxhash64("class"), F.col("subs")[F.col("level")]).cast("int"))
    at, sub = F.col("level"), F.col("sub")

    def blocks(level: Column, make: Callable[[Column], Column]) -> Column:
        """make for each block of a level; none where the hub has no such level."""
        n = F.coalesce(F.try_element_at("subs", level), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), make)).otherwise(F.array().cast("array<struct<l1:int,s1:int,l2:int,s2:int,side:int>>"))

    def pair(l1: Column, s1: Column, l2: Column, s2: Column, side: Column) -> Column:
        return F.struct(*[x.cast("int").alias(n) for x, n in zip((l1, s1, l2, s2, side), ("l1", "s1", "l2", "s2", "side"))])

    whole = F.array(pair(*[F.lit(0)] * 5))
    apart = F.concat(
        blocks(at, lambda t: pair(at, F.least(sub, t), at, F.greatest(sub, t), sub)),
        blocks(at + 1, lambda t: pair(at, sub, at + 1, t, F.lit(0))),
        blocks(at - 1, lambda t: pair(at - 1, t, at, sub, F.lit(1))),
    )
    return tied.select("hub", F.explode(F.when(F.col("small"), whole).otherwise(apart)).alias("e"), "class").select("hub", "e.*", "class")


def _first(names: str):
    order = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie"))
    return order.alias(names)


def groups(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_copies, n_links.

    class_id names the group of documents linked to it, directly or through
    others, copy_id those with equal n-gram sets, each by its least doc_id.
    n_links counts the other documents that are at least ``threshold`` like it,
    copies included.
    """
    rows_ = cut(join(docs, words, threshold, recall, rows, block))
    names = rows_.groupBy("class", "group").agg(_first("copy"))
    tops = names.groupBy("group").agg(F.min("copy").alias("top"))
    names = names.join(tops, "group").select("class", F.col("copy.doc_id").alias("copy_id"), F.col("top.doc_id").alias("class_id"))
    out = rows_.join(names, "class")
    return out.select("doc_id", "class_id", "copy_id", F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))


def dedup(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Of each group, the row with the least doc_id, with all its columns."""
    rows_ = cut(join(docs, words, threshold, recall, rows, block))
    sizes = rows_.groupBy("group").agg(F.count(F.lit(1)).alias("size"), _first("top")).filter("size > 1")
    lost = rows_.join(sizes, "group").groupBy("doc_id", "tie").agg(F.first("top").alias("top"), F.count(F.lit(1)).alias("copies"))
    stays = F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.tie") == F.col("tie"))
    marks = cut(lost.select("doc_id", "tie", stays.alias("stays"), "copies"))
    return retain(docs, lambda c: {"doc_id": c("doc_id").cast("long"), "tie": F.xxhash64(plain(c("text")))}, marks)
