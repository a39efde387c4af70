"""Plain helpers over names, numbers and bytes."""

from __future__ import annotations

import math
import re

from rowlens.model import Dialect, Format, TableSchema

_NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))")
_NAMED = {",": "comma", "\t": "tab", ";": "semicolon", "|": "pipe"}


def fmt_count(n: int) -> str:
    return f"{n:,}"


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    power = min(4, max(1, int(math.log2(n) // 10)))
    return f"{n / 1024**power:.1f} {['KB', 'MB', 'GB', 'TB'][power - 1]}"


def stable_hash(path: str) -> int:
    """FNV-1a, 64 bits, of the path's UTF-8 bytes; names saved views on disk."""
    # The offset basis and the prime of FNV-1a.
    h, prime = 0xCBF29CE484222325, 0x100000001B3
    for b in path.encode("utf-8", "replace"):
        h = (h ^ b) * prime % (1 << 64)
    return h


def looks_numeric(text: str) -> bool:
    """Whether the trimmed text is a decimal or special floating point number."""
    return _NUMBER.fullmatch(text.strip()) is not None


def parse_delimiter(entry: str) -> str | None:
    """The delimiter that a user typed: one ASCII character, or two hexadecimal digits after 0x or \\x."""
    if m := re.fullmatch(r"(?:0x|\\x)([0-9a-fA-F]{2})", entry):
        return chr(int(m[1], 16))
    return entry if len(entry) == 1 and entry.isascii() else None


def delimiter_display(delimiter: str) -> str:
    """A form of the delimiter that can be read and typed again."""
    return delimiter if " " <= delimiter <= "~" else f"0x{ord(delimiter):02x}"


def delimiter_label(delimiter: str) -> str:
    """What a delimiter is called."""
    return _NAMED.get(delimiter, delimiter_display(delimiter))


_LABELS = {Format.PARQUET: "Parquet", Format.JSON_LINES: "NDJSON", Format.JSON_ARRAY: "JSON array"}


def format_label(fmt: Format, dialect: Dialect | None = None) -> str:
    """What a source is called: its format, or its delimiter where it has one."""
    if fmt in _LABELS:
        return _LABELS[fmt]
    delimiter = dialect.delimiter if dialect else ","
    return {",": "CSV", "\t": "TSV"}.get(delimiter, f"text, by {delimiter_label(delimiter)}")


def decode_field(raw: bytes, encoding: str = "utf-8") -> str:
    """Display text of bytes: undecodable ones become U+FFFD, a leading byte order mark goes."""
    return raw.decode(encoding, "replace").removeprefix("﻿")


def raw_name(schema: TableSchema, column: int) -> str:
    """A column's name without a byte order mark; empty if there is no such column."""
    return schema.columns[column].name.removeprefix("﻿") if 0 <= column < len(schema) else ""


def column_name(schema: TableSchema, column: int) -> str:
    """A column's name for display."""
    return raw_name(schema, column) if 0 <= column < len(schema) else f"col{column}"


def export_names(schema: TableSchema, columns: list[int]) -> list[str]:
    """Names for formats that need one: an empty one becomes col and the column's place in the export."""
    return [raw_name(schema, c) or f"col{i}" for i, c in enumerate(columns)]
