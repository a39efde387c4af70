"""Stored values as the text of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render(column: Column, kind: T.DataType, style: str = "spark") -> Column:
    """A value's text; a null is the empty text.

    Scalars are cast. Lists, maps and structs become compact JSON, binary values
    hexadecimal digits. style "iso" writes timestamps with a T between date and
    time, style "spark" with a space.
    """
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(column))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.VariantType):
        text = F.to_json(column)
    elif isinstance(kind, T.NullType):
        return F.lit("")
    else:
        text = column.cast("string")
        if style == "iso" and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = F.regexp_replace(text, " ", "T")
    return F.coalesce(text, F.lit(""))
