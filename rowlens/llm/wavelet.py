"""Token ids kept in wavelet matrices: one compressed, indexed blob per shard segment.

A wavelet matrix keeps a sequence of symbols as bit planes, the most
significant bit first; after each plane the sequence is split stably, zeros
first. With a directory of counted ones, a plane answers rank in constant
time, and so the matrix answers access, rank, select, counting and occurrence
lookup without being expanded. The directory is stored, and the planes are
compressed in blocks, so that a question inflates only the blocks it touches.

File format, little-endian: magic ``RLWM``, version u8, bits u8, u16 zero, n
u64, docs u64, size of the front u64 and of its frame u64; one zstd frame, the
front, with: doc ids i64[docs], document lengths u32[docs] (0xFFFFFFFF never
occurs), zeros of each plane u64[bits], for each plane its ones before every
STEP bits u32[n / STEP, rounded up, and 1], and the sizes of the blocks' frames
u32[bits][blocks]; then, plane by plane, a zstd frame for every BLOCK bits,
first position in the highest bit, in bytes padded to whole steps.

The blobs are rows of a Parquet table that Spark's writer commits, so any file
system that Spark reaches will do and a lost executor leaves no torn file.

Defined cases: a null or empty text has the end id alone; rows with equal or
null doc_ids (nulls first) are ordered by a hash of the text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import fields, scratch, ship, text_of
from rowlens.llm.tokens import encoder

MAGIC = b"RLWM"
HEAD = struct.Struct("<4sBBHQQQQ")
END_ID = 2
#: A segment ends with the document that reaches so many ids.
SEGMENT_IDS = 1 << 20
#: Bits between entries of the rank directory, and of a block of a plane, which is inflated at once.
STEP, BLOCK = 512, 1 << 16


def _bits_of(ids: np.ndarray) -> int:
    return max(1, int(ids.max()).bit_length()) if len(ids) else 1


def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    import zstandard

    if len(ids) >> 32:
        raise ValueError("a segment holds fewer than 2^32 ids")
    z = zstandard.ZstdCompressor(level=1)
    bits, n = _bits_of(ids), len(ids)
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    frames, ranks, zeros = [], [], np.zeros(bits, "<u8")
    for k in range(bits):
        ones = (x & x.dtype.type(1 << (bits - 1 - k))) != 0
        plane = np.packbits(np.pad(ones, (0, -n % STEP)))
        ranks.append(np.cumsum(np.concatenate([[0], np.bitwise_count(plane.reshape(-1, STEP // 8)).sum(1, dtype=np.int64)])).astype("<u4"))
        raw = plane.tobytes()
        frames += [z.compress(raw[i : i + BLOCK // 8]) for i in range(0, len(raw), BLOCK // 8)]
        low = np.flatnonzero(~ones)  # taking by position is several times faster than by mask
        zeros[k] = len(low)
        if k < bits - 1:
            x = np.concatenate([x.take(low), x.take(np.flatnonzero(ones))])
    sizes = np.array([len(f) for f in frames], "<u4")
    front = b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), zeros.tobytes(), *(r.tobytes() for r in ranks), sizes.tobytes()])
    packed = z.compress(front)
    return b"".join([HEAD.pack(MAGIC, 2, bits, 0, n, len(doc_ids), len(front), len(packed)), packed, *frames])


class WaveletMatrix:
    """One blob, of which only the front is read until more is asked for."""

    def __init__(self, blob: bytes):
        import zstandard

        magic, version, self.bits, _, self.n, docs, size, packed = HEAD.unpack_from(blob)
        if magic != MAGIC or version != 2:
            raise ValueError("not a wavelet matrix of this format")
        self._inflate = zstandard.ZstdDecompressor().decompress
        front = self._inflate(blob[HEAD.size : HEAD.size + packed], max_output_size=size) if size else b""
        steps = -(-self.n // STEP)
        self.doc_ids = np.frombuffer(front, "<i8", docs)
        self.lengths = np.frombuffer(front, "<u4", docs, 8 * docs)
        at = 12 * docs
        self.zeros = np.frombuffer(front, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.ranks = np.frombuffer(front, "<u4", self.bits * (steps + 1), at).astype(np.int64).reshape(self.bits, steps + 1)
        at += 4 * self.bits * (steps + 1)
        self.blocks = -(-self.n // BLOCK)
        ends = HEAD.size + packed + np.cumsum(np.frombuffer(front, "<u4", self.bits * self.blocks, at), dtype=np.int64)
        if len(blob) != (int(ends[-1]) if len(ends) else HEAD.size + packed):
            raise ValueError("torn wavelet matrix")
        self._blob, self._bounds = blob, np.concatenate([[HEAD.size + packed], ends])
        self._known: dict[int, np.ndarray] = {}

    def block(self, k: int, j: int) -> np.ndarray:
        """The bytes of a plane's jth block."""
        i = k * self.blocks + j
        if i not in self._known:
            self._known[i] = np.frombuffer(self._inflate(self._blob[self._bounds[i] : self._bounds[i + 1]], max_output_size=BLOCK // 8), np.uint8)
        return self._known[i]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        step = i // STEP
        total = int(self.ranks[k][step])
        if i % STEP == 0:
            return total
        own = self.block(k, i // BLOCK)
        a, b = step * STEP % BLOCK // 8, i % BLOCK // 8
        total += int(np.bitwise_count(own[a:b]).sum())
        return total + (int(own[b]) >> (8 - i % 8)).bit_count() if i % 8 else total

    def _ones_at(self, k: int, at: np.ndarray) -> np.ndarray:
        """As _ones, for many positions, ascending."""
        total = self.ranks[k][at // STEP]
        for j in np.unique(at[at % STEP > 0] // BLOCK).tolist():
            here = np.flatnonzero((at // BLOCK == j) & (at % STEP > 0))
            rows = np.bitwise_count(self.block(k, j)).reshape(-1, STEP // 8)
            inside = at[here] % BLOCK
            step, byte = inside // STEP, inside % STEP // 8
            before = np.cumsum(rows[step], axis=1, dtype=np.int64) - rows[step]
            part = self.block(k, j)[inside // 8] >> (8 - inside % 8).astype(np.uint8)
            total[here] += before[np.arange(len(here)), byte] + np.where(inside % 8, np.bitwise_count(part), 0)
        return total

    def ranks_at(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """As rank, for many positions, ascending."""
        if symbol < 0 or symbol >> self.bits:
            return np.zeros(len(at), np.int64)
        a, b = 0, np.asarray(at, np.int64)
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones_at(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if symbol >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return b - a

    def _bit(self, k: int, i: int) -> int:
        return int(self.block(k, i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            symbol = symbol << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return symbol

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbols among the first i are after the last plane: from, to."""
        a, b = 0, i
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            if symbol >> (self.bits - 1 - k) & 1:
                a, b = int(self.zeros[k]) + x, int(self.zeros[k]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """How often the symbol is among the first i."""
        if symbol < 0 or symbol >> self.bits:
            return 0
        a, b = self._range(symbol, min(max(i, 0), self.n))
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth such bit (from 0) of plane k."""
        ranks = self.ranks[k]
        before = ranks if bit else np.arange(len(ranks)) * STEP - ranks
        step = int(np.searchsorted(before, nth, "right")) - 1
        a = step * STEP % BLOCK // 8
        own = np.unpackbits(self.block(k, step * STEP // BLOCK)[a : a + STEP // 8])
        return step * STEP + int(np.flatnonzero(own == bit)[nth - int(before[step])])

    def select(self, symbol: int, nth: int) -> int:
        """Position of the symbol's nth occurrence, from 0."""
        if not 0 <= nth < self.count(symbol):
            raise IndexError(nth)
        i = self._range(symbol, self.n)[0] + nth
        for k in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - k) & 1
            i = self._find(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols: from the last plane up, each split is undone."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            plane = np.concatenate([self.block(k, j) for j in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
            ones = np.unpackbits(plane, count=self.n).astype(bool)
            back = np.empty_like(x)
            back[np.flatnonzero(~ones)] = x[: self.zeros[k]]
            back[np.flatnonzero(ones)] = x[self.zeros[k] :] | x.dtype.type(1 << (self.bits - 1 - k))
            x = back
        return x


def _writer(path: str, keeps_spaces: bool, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            blob = encode(np.concatenate(ids), np.array([x or 0 for x in docs], np.int64), sizes)
            nulls = [i for i, x in enumerate(docs) if x is None]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([nulls], pa.list_(pa.int32())), pa.array([blob], pa.binary())],
                names=["shard", "segment", "n_ids", "null_docs", "blob"],
            )

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder(path, keeps_spaces).encode(batch.column(1))):
                docs.append(doc_id)
                ids += [np.concatenate([own, end])]
                held += len(own) + 1
                if held >= most:
                    yield flush()
                    segment, docs, ids, held = segment + 1, [], [], 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, keeps_spaces: bool, end_id: int = END_ID, most: int = SEGMENT_IDS) -> None:
    """Writes the ids of all documents, ascending by doc_id over shards, segments and places in them."""
    ship(docs.sparkSession)
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = rows.mapInArrow(_writer(tokenizer, keeps_spaces, end_id, most), "shard int, segment int, n_ids long, null_docs array<int>, blob binary")
    out.write.option("compression", "uncompressed").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, nulls, blob in zip(*(batch.column(i) for i in range(3))):
            w = WaveletMatrix(blob.as_py())
            ids = w.decode().astype("<u4")
            ends = np.cumsum(w.lengths, dtype=np.int64)
            starts = ends - w.lengths
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist())]
            found = np.diff(w.ranks_at(END_ID, np.concatenate([starts[:1], ends])))
            null = np.zeros(len(w.doc_ids), bool)
            null[nulls.as_py()] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.doc_ids, mask=null), pa.array(starts + before.as_py()), pa.array(w.lengths.astype(np.int64)), pa.array(crcs, pa.int64()), pa.array(found)],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_end"],
            )


def _counter(symbols: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                w = WaveletMatrix(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), pa.array([w.count(x) for x in symbols], pa.int64())], names=["symbol", "n"])

    return run


def _finder(symbols: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nulls, blob in zip(*batch.columns):
                w = WaveletMatrix(blob.as_py())
                ends = np.cumsum(w.lengths, dtype=np.int64)
                null = np.zeros(len(w.doc_ids), bool)
                null[nulls.as_py()] = True
                for symbol in symbols:
                    at = np.array(w.occurrences(symbol), np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), symbol)), pa.array(w.doc_ids[doc], mask=null[doc]), pa.array(at - ends[doc] + w.lengths[doc])], names=["symbol", "doc_id", "place"]
                    )

    return run


def count(spark, path: str, symbols: list[int]) -> DataFrame:
    """symbol, n: how often each is in the files, by rank in every segment."""
    ship(spark)
    found = spark.read.parquet(path).select("blob").mapInArrow(_counter(symbols), "symbol long, n long")
    return found.groupBy("symbol").agg(F.sum("n").alias("n"))


def occurrences(spark, path: str, symbols: list[int]) -> DataFrame:
    """symbol, doc_id, place in the document's ids: by select in every segment."""
    ship(spark)
    return spark.read.parquet(path).select("null_docs", "blob").mapInArrow(_finder(symbols), "symbol long, doc_id long, place long")


def read(spark, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, and n_end, how often the end id is among a document's ids, by rank.

    What stands before a segment is summed within its shard, and over the
    shards' totals: as many rows as shards, two numbers each.
    """
    ship(spark)
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(shards, "shard")
    sums = sums.select("shard", "segment", (F.col("earlier") + F.col("own")).alias("before"))
    found = files.select("shard", "segment", "null_docs", "blob").join(sums, ["shard", "segment"])
    return found.select("before", "null_docs", "blob").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end long")


def round_trip(docs: DataFrame, tokenizer: str, keeps_spaces: bool) -> DataFrame:
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, keeps_spaces)
    return read(docs.sparkSession, path)
