"""Secrets in texts, and in what is encoded in them.

A scan finds assignments, access keys and hexadecimal keys by rules. A worklist
then takes each encoded stretch of the text (URL escapes, Unicode escapes,
base64 or hexadecimal, also over line breaks, compressed bytes within those), decodes it, scans the
layer that comes out and puts its own encoded stretches on the list, until
nothing new comes up. A layer seen before in a text, by its hash, is not opened
again at the same place, which ends cycles. Every layer keeps where in the whole text each of its
characters came from, so a find is reported at the stretch of the original that
it was unwrapped from. Base finds in the text itself always stay.

Defined cases: a null text counts as empty; equal rows are scanned each on its
own; a compressed layer is scanned in windows of ``MOST_BYTES``, and one that
breaks off as far as it goes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Generator, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import fields, ship, sliced, text_of

#: Kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
# The rules of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of runs of such characters, the long ones
LEAST = {"assign": 6, "access": 20}
#: Bytes of an unpacked layer that are scanned at once, and those that two such windows share.
MOST_BYTES = 1 << 24
OVERLAP = 1 << 20
#: Compressed bytes unpacked at once, which bounds what they become.
STEP = 16

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE_ONE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&([A-Za-z][A-Za-z0-9]{1,31};)"
)
_BREAK = r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+"  # of a line, or its escape in JSON
_BREAKS = re.compile(_BREAK)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+{_BREAK})++[A-Za-z0-9+/_-]*+={{0,2}}")
_HEXED = re.compile(r"[0-9a-fA-F]{24,}")
_HEXED_LINES = re.compile(rf"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{{24,}}+{_BREAK})++[0-9a-fA-F]*+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")


def base(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end of each find of the rules, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class _Spans:
    """Where the characters of an unescaped layer came from: runs that stayed as they were, and escapes."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.runs: list[tuple[int, int, bool]] = []  # start and end of the source, whether it stayed
        self.parts: list[str] = []
        self.size = 0

    def add(self, text: str, start: int, end: int, stayed: bool) -> None:
        if text:
            self.starts.append(self.size)
            self.runs.append((start, end, stayed))
            self.parts.append(text)
            self.size += len(text)

    def whence(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        start, _, stayed = self.runs[i]
        last, end, still = self.runs[j]
        return start + (a - self.starts[i] if stayed else 0), last + b - self.starts[j] if still else end

    def stayed(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a) - 1
        return self.runs[i][2] and i == bisect_right(self.starts, b - 1) - 1


def _opener(magic: bytes):
    if magic.startswith(b"\x28"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(31 if magic.startswith(b"\x1f") else 15)


def _unpacked(data: bytes, at: int) -> Generator[bytes, None, int]:
    """What the stream at a place gives, its later members and frames included, up to its end or first fault; returns where it ended."""
    while m := _MAGIC.match(data, at):
        d, i = _opener(m[0]), at
        try:
            while not d.eof and i < len(data):
                if some := d.decompress(data[i : i + STEP]):
                    yield some
                i += STEP
        except Exception:  # not what its first bytes promised
            return m.end()
        if not d.eof:
            return len(data)
        at = min(i, len(data)) - len(d.unused_data)
        if m[0].startswith(b"\x1f"):  # members may be padded
            while data.startswith(b"\0", at):
                at += 1
    return at


def _texts(data: bytes, seen: set[bytes] | None = None) -> Iterator[str]:
    """Texts of decoded bytes: as they are, and of the compressed layers that begin in them."""
    seen = set() if seen is None else seen
    yield data.decode("utf-8", "replace")
    at = 0
    while m := _MAGIC.search(data, at):
        stream, window, at = _unpacked(data, m.start()), bytearray(), None
        while at is None:
            try:
                window += next(stream)
            except StopIteration as end:
                at = end.value
            if window and (at is not None or len(window) >= MOST_BYTES):
                mark = hashlib.blake2b(window, digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    yield from _texts(bytes(window), seen)
                del window[: max(0, len(window) - OVERLAP)]


def _url(s: str) -> tuple[str, _Spans]:
    spans, at = _Spans(), 0
    for m in _ESCAPES.finditer(s):
        spans.add(s[at : m.start()], at, m.start(), True)
        k = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            odd = "\udc80" <= c <= "\udcff"  # one byte that is no UTF-8
            n = 3 if odd else 3 * len(c.encode())
            spans.add("\ufffd" if odd else c, k, k + n, False)
            k += n
        at = m.end()
    spans.add(s[at:], at, len(s), True)
    return "".join(spans.parts), spans


def _unescape(s: str) -> tuple[str, _Spans]:
    spans, at = _Spans(), 0
    high: tuple[str, int, int] | None = None  # the first half of a surrogate pair
    for m in _UNICODE_ONE.finditer(s):
        if m[7]:
            if m[7] not in html5:
                continue
            c = html5[m[7]]
        else:
            code = int(m[5]) if m[5] else int(next(g for g in (m[1], m[2], m[3], m[4], m[6]) if g), 16)
            c = chr(code) if code < 0x110000 else "\ufffd"
        start = m.start()
        if high:
            if high[2] == start and "\udc00" <= c <= "\udfff":
                c, start = chr(0x10000 + ((ord(high[0]) - 0xD800) << 10) + ord(c) - 0xDC00), high[1]
            else:
                spans.add("\ufffd", *high[1:], False)
            high = None
        spans.add(s[at : m.start()], at, m.start(), True)
        at = m.end()
        if "\ud800" <= c <= "\udbff":
            high = c, start, at
        else:
            spans.add("\ufffd" if "\udc00" <= c <= "\udfff" else c, start, at, False)
    if high:
        spans.add("\ufffd", *high[1:], False)
    spans.add(s[at:], at, len(s), True)
    return "".join(spans.parts), spans


def _base64(s: str) -> Iterator[str]:
    """Texts of a stretch, whose first characters may belong to what stands before it."""
    body = _BREAKS.sub("", s).rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = body[k : len(body) - ((len(body) - k) % 4 == 1)]
        yield from _texts(binascii.a2b_base64(part + "=" * (-len(part) % 4)))


def _hexed(s: str) -> Iterator[str]:
    body = _BREAKS.sub("", s)
    for k in range(2):
        yield from _texts(bytes.fromhex(body[k : len(body) - (len(body) - k) % 2]))


def _unwrapped(text: str) -> Iterator[tuple[int, int, str, _Spans | None]]:
    """Of each encoded stretch: start, end, what it decodes to, and the spans of its characters if they are known.

    Escapes are undone in the whole text at once, as what they hide may go on beside them.
    """
    for escape, decode in ((_ESCAPES, _url), (_UNICODE_ONE, _unescape)):
        if escape.search(text):
            yield 0, len(text), *decode(text)
    for stretches, decode in ((_BASE64_LINES, _base64), (_BASE64, _base64), (_HEXED_LINES, _hexed), (_HEXED, _hexed)):
        for m in stretches.finditer(text):
            if decode is _hexed or _looks_encoded(m[0]):
                for x in decode(m[0]):
                    yield m.start(), m.end(), x, None


def _looks_encoded(s: str) -> bool:
    """A word of small letters is no base64 that holds a secret: three bytes of text make four of mixed characters."""
    return not s.islower() or any(c.isdigit() for c in s)


def scan(text: str, first: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """All finds, of the text (first, if they are known) and of its layers: kind, start, end in the text; by start, kind, end."""
    found = set(base(text) if first is None else first)
    seen = {hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()}
    # a layer's characters come from: None, the text itself; a pair, all from one stretch of it; else through each spans in turn

    def whence(origin: tuple | None, a: int, b: int) -> tuple[int, int]:
        while origin is not None:
            outer, spans = origin
            if not isinstance(spans, _Spans):
                return origin
            a, b = spans.whence(a, b)
            origin = outer
        return a, b

    work: list[tuple[Iterator, tuple | None]] = [(_unwrapped(text), None)]  # only one layer of each depth at a time
    while work:
        layers, origin = work[-1]
        if (layer := next(layers, None)) is None:
            work.pop()
        else:
            start, end, inner, spans = layer
            own = whence(origin, start, end)
            mark = hashlib.blake2b(inner.encode(errors="surrogatepass") + b"\0%d" % own[0], digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            inside = own if spans is None else (origin, spans)
            for kind, a, b in base(inner):
                if spans is None or not spans.stayed(a, b):  # else the layer around it has it
                    found.add((kind, *whence(inside, a, b)))
            work.append((_unwrapped(inner), inside))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        shas, spans = [], []
        for text in batch.column(1):
            text = text.as_py()
            found = base(text)
            for k in KINDS:
                counts[k].append(sum(x[0] == k for x in found))
            shas.append(hashlib.sha256(_said(found).encode()).hexdigest())
            spans.append(_said(scan(text, found)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document."""
    ship(docs.sparkSession)
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
