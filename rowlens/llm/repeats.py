"""Removing repeated passages: radix passes over suffixes, limited to the threshold's depth.

A byte goes if some ``depth`` bytes that cover it also start anywhere else.
Suffixes need to be told apart through their first ``depth`` bytes only, and
groups of them that agree that far are exactly the repeated windows. The passes
go from a coarse digit to a full one; after each, a suffix that is alone in its
group is dropped, and one whose whole stretch has an equal is decided:

1. Suffixes fall into runs: neighbours whose windows have the same least k-byte
   string (by a hash; the leftmost of equals). Equal windows have equal least
   strings at equal offsets, so that string is the first digit: runs are grouped
   by it, and most, being alone, end here.
2. The digit is the run's whole stretch of bytes. Runs that are equal throughout
   are decided without looking at their suffixes.
3. Only where one string heads different stretches, one run of each kind goes
   on. The windows of a small group are put in order in one task by their own
   bytes, the most significant digits of eight first, down to the depth; those
   that still share a group then are equal, byte for byte.
4. Runs of large groups are cut into blocks of ``STEP`` starts, aligned to the
   first digit. The digit is what all windows of a block have in common; blocks
   alone with theirs end here, and those equal throughout are decided.
5. One block of each kind that is left is spelled out, and its full windows are
   shuffled.

The digits of passes 1, 2, 4 and 5 are 64-bit hashes, each compared along with
the first one, so their groups come in no lexicographic order, which the result
does not need; two unlike stretches with one first digit are taken for equal
with a chance of 2^-64.

Defined cases: a null text counts as empty; texts below ``depth`` bytes lose
nothing; equal documents of ``depth`` bytes or more lose all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import cut, fields, ship, sliced, text_of
from rowlens.llm.rolling import Prefix, mix, sliding_min

DEPTH = 200
#: Length of the first digit.
HEAD = 48
#: Groups with more kinds of runs than this (some 300 bytes each) don't meet in one task.
LARGE = 256
STEP = 16
#: Window starts that are handled at once; their places fit LOW.
CHUNK = 1 << 21
LOW = np.uint64((1 << 22) - 1)
#: pos holds a run's first start, its length less one (8 bits) and 23 bits of the text's size.
SIZE_BITS, LEN_BITS = 23, 8
EMIT = 200_000


def runs(data: np.ndarray, bounds: np.ndarray, depth: int, head: int):
    """Runs of the texts that data joins at bounds: text, first start, last start (in data), digit, stretch."""
    prefix = Prefix(data)
    digits = prefix.all(head)
    places = np.arange(len(digits), dtype=np.uint64)
    least = sliding_min((digits & ~LOW) | places, depth - head + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + depth <= bounds[1:][text])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = (least[start] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last, at = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1], at[new]
    shape = mix(((at - first) << 20 | (last - first)).astype(np.uint64))
    return text[first], first, last, digits[at], prefix.of(first, last + depth) ^ shape


def _chunks(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Joined texts of up to about CHUNK bytes: data, bounds, (text, offset) of each part. Long texts are cut with overlap."""
    parts: list[bytes] = []
    known: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - depth + 1), CHUNK):
            part = t[off : off + CHUNK + depth - 1]
            if parts and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), known
                parts, known, size = [], [], 0
            parts.append(part)
            known.append((i, off))
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), known


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _scan(depth: int, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = _texts(batch.column(1))
            sizes = np.array([len(t) for t in texts], np.int64)
            for data, bounds, known in _chunks(texts, depth):
                text, first, last, digit, stretch = runs(data, bounds, depth, head)
                own, off = (np.array([x[i] for x in known], np.int64) for i in (0, 1))
                doc = own[text]
                lo = first - bounds[text] + off[text]
                pos = lo << (SIZE_BITS + LEN_BITS) | (last - first) << SIZE_BITS | sizes[doc] % (1 << SIZE_BITS)
                for i in range(0, len(doc), EMIT):
                    s = slice(i, i + EMIT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digit[s].view(np.int64)), pa.array(stretch[s].view(np.int64)), pa.array(keys[doc[s]]), pa.array(pos[s])],
                        names=["digit", "stretch", "key", "pos"],
                    )

    return run


def _stretches(depth: int):
    """Of documents and the runs asked for, each run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            key, texts, digits, poss = batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cols: list[list] = [[], [], [], []]
            for k, t, ds, ps in zip(key, texts, digits, poss):
                for d, p in zip(ds, ps):
                    lo, more = p >> (SIZE_BITS + LEN_BITS), p >> SIZE_BITS & (1 << LEN_BITS) - 1
                    if p % (1 << SIZE_BITS) != len(t) % (1 << SIZE_BITS):
                        continue  # another text under the same key
                    for c, x in zip(cols, (d, k, p, t[lo : lo + more + depth])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["digit", "key", "pos", "bytes"]
            )

    return run


def _windows(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches: their joined bytes, and of each window which one it is in, its start in that, and in the joined bytes."""
    parts = column.to_pylist()
    bounds = np.cumsum([0, *map(len, parts)])
    counts = np.diff(bounds) - depth + 1
    which = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(b"".join(parts), np.uint8), which, start, bounds[which] + start


def radix(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Of the strings of depth bytes that start at these places: those with an equal in their group, ascending by group and bytes.

    Each pass takes the next eight bytes as a digit, the most significant
    first, orders the members of each group by it and splits the group where
    the digit changes; a member left alone is dropped.
    """
    left = np.argsort(group, kind="stable")
    g = np.cumsum(np.diff(group[left], prepend=group[left[:1]]) != 0)
    words = np.ndarray(len(data), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    for k in range(0, depth, 8):
        digit = words[at[left] + k] >> np.uint64(8 * max(0, k + 8 - depth))
        first = np.flatnonzero(np.diff(g, prepend=-1))
        mixed = np.bincount(g, digit != digit[first][g]) > 0
        some = np.flatnonzero(mixed[g])
        if len(some):  # the members of other groups are in order as they are
            order = some[np.lexsort((digit[some], g[some]))]
            left[some], digit[some] = left[order], digit[order]
        g = np.cumsum((np.diff(g, prepend=g[:1]) != 0) | (np.diff(digit.astype(np.uint64), prepend=digit[:1].astype(np.uint64)) != 0))
        several = np.bincount(g)[g] > 1
        left, g = left[several], g[several]
        if not len(left):
            break
        g = np.cumsum(np.diff(g, prepend=g[:1]) != 0)
    return left


def _spans(key: np.ndarray, pos: np.ndarray, which: np.ndarray, start: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Repeated windows, ascending by stretch and start, joined to runs: key, pos."""
    which, start = which[again], start[again]
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)])) if len(which) else which
    first = start[new]
    more = start[np.concatenate([new[1:], [len(start)]]).astype(int) - 1] - first if len(new) else first
    base = pos[which[new]]
    lo = (base >> (SIZE_BITS + LEN_BITS)) + first
    out = lo << (SIZE_BITS + LEN_BITS) | more << SIZE_BITS | base % (1 << SIZE_BITS)
    return pa.RecordBatch.from_arrays([pa.array(key[which[new]], pa.int64()), pa.array(out, pa.int64())], names=["key", "pos"])


def _small(depth: int):
    """Rows come sorted by digit; all of a digit's are looked at together."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        digit, key, pos = (rows.column(i).to_numpy() for i in range(3))
        data, which, start, at = _windows(rows.column(3).combine_chunks(), depth)
        again = np.zeros(len(at), bool)
        again[radix(data, at, digit[which], depth)] = True
        return _spans(key, pos, which, start, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for piece in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                digits = piece.column(0).to_numpy()
                cut_at = int(np.searchsorted(digits != digits[-1], False)) if digits[0] == digits[-1] else int(np.flatnonzero(digits != digits[-1])[-1]) + 1
                if cut_at:
                    yield found(pa.Table.from_batches([*held, piece.slice(0, cut_at)]))
                    held = []
                elif held and held[-1].column(0)[0].as_py() != digits[0]:
                    yield found(pa.Table.from_batches(held))
                    held = []
                held.append(piece.slice(cut_at))
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _blocks(depth: int, head: int):
    """Of stretches, their blocks: digit, core, whole, key, pos, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                digit, key, pos = (piece.column(i).to_numpy() for i in range(3))
                parts = piece.column(3).to_pylist()
                bounds = np.cumsum([0, *map(len, parts)])
                data = np.frombuffer(b"".join(parts), np.uint8)
                prefix = Prefix(data)
                more = np.diff(bounds) - depth  # the last start
                # the digit's place: the first from the last start on
                digits = prefix.all(head)
                own = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(digits)]
                hit = np.flatnonzero((digits.view(np.int64) == digit[own]) & (np.arange(len(digits)) - bounds[own] >= more[own]))
                _, one = np.unique(own[hit], return_index=True)
                at = hit[one] - bounds[:-1]
                which = np.repeat(np.arange(len(parts)), more + 1)
                start = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                block = (at[which] - start) // STEP
                new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])]))
                w, lo, b = which[new], start[new], block[new]
                hi = start[np.concatenate([new[1:], [len(start)]]) - 1]
                base, a = bounds[w], at[w]
                core = prefix.of(base + a - b * STEP, base + a - b * STEP - STEP + 1 + depth) ^ mix(b.astype(np.uint64))
                whole = prefix.of(base + lo, base + hi + depth) ^ mix(((a - lo) << 20 | (hi - lo)).astype(np.uint64))
                run_pos = (pos[w] >> (SIZE_BITS + LEN_BITS)) + lo << (SIZE_BITS + LEN_BITS) | (hi - lo) << SIZE_BITS | pos[w] % (1 << SIZE_BITS)
                texts = [data[x:y].tobytes() for x, y in zip((base + lo).tolist(), (base + hi + depth).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digit[w]), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(key[w]), pa.array(run_pos), pa.array(texts, pa.binary())],
                    names=["digit", "core", "whole", "key", "pos", "bytes"],
                )

    return run


def _spell(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                digit, key, pos = (piece.column(i).to_numpy() for i in range(3))
                data, which, start, at = _windows(piece.column(3), depth)
                window = Prefix(data).of(at, at + depth)
                one = (pos[which] >> (SIZE_BITS + LEN_BITS)) + start << (SIZE_BITS + LEN_BITS) | pos[which] % (1 << SIZE_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digit[which]), pa.array(window.view(np.int64)), pa.array(key[which]), pa.array(one)], names=["digit", "window", "key", "pos"]
                )

    return run


def _keep(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            cols: list[list] = [[], [], [], []]
            for t, spans in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                n, kept, removed, count, at = len(t), hashlib.sha256(), 0, 0, 0
                own = sorted(p for p in spans or () if p % (1 << SIZE_BITS) == n % (1 << SIZE_BITS))
                i = 0
                while i < len(own):
                    lo = own[i] >> (SIZE_BITS + LEN_BITS)
                    hi = lo
                    while i < len(own) and (own[i] >> (SIZE_BITS + LEN_BITS)) <= hi:
                        hi = max(hi, (own[i] >> (SIZE_BITS + LEN_BITS)) + (own[i] >> SIZE_BITS & (1 << LEN_BITS) - 1) + depth)
                        i += 1
                    kept.update(t[at:lo])
                    removed, count, at = removed + hi - lo, count + 1, hi
                kept.update(t[at:])
                for c, x in zip(cols, (n, removed, count, kept.hexdigest())):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated(docs: DataFrame, depth: int = DEPTH, head: int = HEAD, large: int = LARGE) -> DataFrame:
    """Runs of repeated windows: key (xxhash64 of the text), pos; each once."""
    if not head <= depth <= head + (1 << LEN_BITS) - 1:
        raise ValueError("the first digit must be shorter than the depth, by 255 bytes at most")
    ship(docs.sparkSession)
    docs = fields(docs, "text")
    texts = docs.select(F.xxhash64(text_of(docs)).alias("key"), text_of(docs).alias("text"))
    all_runs = texts.filter(F.octet_length("text") >= depth).mapInArrow(_scan(depth, head), "digit long, stretch long, key long, pos long")
    # 1: digits that head more than one run
    heads = cut(all_runs.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit"))
    left = all_runs.join(heads, "digit", "left_semi")
    # Copies of a text become one. Grouped by the digit itself, the join's tasks would have to keep a frequent one whole.
    left = left.groupBy(F.bitwise_not("digit").alias("not_digit"), "stretch", "key", "pos").agg(F.count(F.lit(1)).alias("n"))
    left = cut(left.select(F.bitwise_not("not_digit").alias("digit"), "stretch", "key", "pos", "n"))
    # 2: equal stretches
    kinds = left.groupBy("digit", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("key", "pos")).alias("one"))
    kinds = cut(kinds.select("digit", "stretch", "n", "one.key", "one.pos"))
    equal = left.select("digit", "stretch", "key", "pos").join(kinds.filter("n > 1").select("digit", "stretch"), ["digit", "stretch"], "left_semi").select("key", "pos")
    # 3: one run of each kind, where there are several under a digit
    several = cut(kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    asked = kinds.join(several, "digit").select("digit", "key", "pos", "kinds")
    lists = asked.groupBy("key").agg(F.collect_list("digit").alias("digits"), F.collect_list("pos").alias("poss"))
    once = texts.join(cut(lists), "key")  # written, so that a task with many copies of a text can be split
    spelled = once.select("key", "text", "digits", "poss").mapInArrow(_stretches(depth), "digit long, key long, pos long, bytes binary")
    # copies of a text give the same bytes; any of them will do
    spelled = spelled.groupBy("digit", "key", "pos").agg(F.first("bytes").alias("bytes"))
    spelled = cut(spelled)
    small = spelled.join(several.filter(F.col("kinds") <= large).select("digit"), "digit", "left_semi")
    small = small.repartition("digit").sortWithinPartitions("digit").select("digit", "key", "pos", "bytes").mapInArrow(_small(depth), "key long, pos long")
    many = spelled.join(several.filter(F.col("kinds") > large).select("digit"), "digit", "left_semi").select("digit", "key", "pos", "bytes")
    # 4: blocks by what their windows have in common
    blocks = cut(many.mapInArrow(_blocks(depth, head), "digit long, core long, whole long, key long, pos long, bytes binary"))
    shapes = blocks.groupBy("digit", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "bytes")).alias("one"))
    shapes = cut(shapes.select("digit", "core", "whole", "n", "one.key", "one.pos", "one.bytes"))
    alike = shapes.filter("n > 1").select("digit", "core", "whole")
    alike = blocks.select("digit", "core", "whole", "key", "pos").join(alike, ["digit", "core", "whole"], "left_semi").select("key", "pos")
    # 5: full windows of one block of each kind, where several have a core
    unlike = shapes.groupBy("digit", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("digit", "core")
    unlike = shapes.join(unlike, ["digit", "core"], "left_semi").select("digit", "key", "pos", "bytes")
    windows = cut(unlike.mapInArrow(_spell(depth), "digit long, window long, key long, pos long"))
    full = cut(windows.groupBy("digit", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit", "window"))
    many = alike.unionByName(windows.join(full, ["digit", "window"], "left_semi").select("key", "pos"))
    return equal.unionByName(small).unionByName(many).distinct()


def remove(docs: DataFrame, depth: int = DEPTH, head: int = HEAD, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per document."""
    spans = cut(repeated(docs, depth, head, large).groupBy("key").agg(F.collect_list("pos").alias("spans")))
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("key"), text_of(docs).alias("text"))
    out = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_keep(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
