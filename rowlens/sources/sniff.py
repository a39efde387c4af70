"""What a file is, from its first bytes: format, JSON shape, delimiter, header, encoding.

These run on the driver over a bounded head, never the whole file.
"""

from __future__ import annotations

import csv
import io
import json
import re

from rowlens.functions.text import looks_numeric
from rowlens.model import Dialect, Format

HEAD_BYTES = 64 * 1024
DIALECT_RECORDS = 20
#: Delimiters tried, the earlier one winning a tie.
DELIMITERS = ",\t;|"
_SUFFIXES = {"parquet": Format.PARQUET, "pqt": Format.PARQUET, "ndjson": Format.JSON_LINES, "jsonl": Format.JSON_LINES}
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def read_head(spark, path: str, most: int = HEAD_BYTES) -> bytes:
    """Up to so many first bytes of a file, or of the first data file of a folder; empty if it can't be read."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if fs.getFileStatus(where).isDirectory():
            inside = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "._")
            if not inside:
                return b""
            where = jvm.org.apache.hadoop.fs.Path(inside[0])
        stream = fs.open(where)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
        finally:
            stream.close()
    except Exception:  # a file that can't be read is an empty one here; opening it will say why
        return b""


def encoding_of(head: bytes) -> tuple[str, bytes]:
    """The encoding that a byte order mark names, else UTF-8, and the head in UTF-8 without the mark."""
    for mark, name in _BOMS:
        if head.startswith(mark):
            body = head[len(mark) :]
            return name, body if name == "utf-8" else body[: len(body) // 2 * 2].decode(name, "replace").encode()
    return "utf-8", head


def json_shape(head: bytes) -> Format | None:
    """Lines or array, if the head is JSON of one of these shapes.

    An array's bracket must be followed by a value, its end, or nothing more in
    the head; for lines, the first line must be a whole object.
    """
    body = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\n\r\x0c")
    if body.startswith(b"["):
        rest = body[1:].lstrip(b" \t\n\r\x0c")
        return Format.JSON_ARRAY if not rest or re.match(rb"""[\[\]{"\-0-9tfn]""", rest) else None
    if body.startswith(b"{"):
        try:
            json.loads(body.split(b"\n", 1)[0])
        except ValueError:
            return None
        return Format.JSON_LINES
    return None


def detect_format(spark, path: str, head: bytes | None = None) -> Format:
    """By content; by the name's suffix only where the content says nothing."""
    head = read_head(spark, path) if head is None else head
    if head.startswith(b"PAR1"):
        return Format.PARQUET
    found = json_shape(encoding_of(head)[1])
    return found or _SUFFIXES.get(path.rpartition(".")[2].lower(), Format.DELIMITED)


def records(sample: str, delimiter: str, most: int, quote: str = '"') -> list[list[str]]:
    """Up to so many first records; blank lines are none."""
    limit = csv.field_size_limit(1 << 30)
    try:
        out: list[list[str]] = []
        for row in csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter, quotechar=quote):
            if row:
                out.append(row)
            if len(out) == most:
                break
        return out
    except csv.Error:
        return out
    finally:
        csv.field_size_limit(limit)


def consistency(sample: str, delimiter: str) -> int:
    """Of the first records, how many have as many fields as the first; 0 if that has one."""
    widths = [len(r) for r in records(sample, delimiter, DIALECT_RECORDS)]
    return widths.count(widths[0]) if widths and widths[0] > 1 else 0


def sniff_dialect(head: bytes) -> Dialect:
    """The delimiter of the most consistent records, and a header if no field of the first is a number."""
    sample = encoding_of(head)[1].decode("utf-8", "replace")
    # max keeps the earliest of equals; without any score that is the comma
    delimiter = max(DELIMITERS, key=lambda d: consistency(sample, d))
    first = records(sample, delimiter, 1)
    return Dialect(delimiter, '"', not first or not any(map(looks_numeric, first[0])))
