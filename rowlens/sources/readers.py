"""Sources as DataFrames of RID, c0..cN and, for delimited text, RAGGED."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.ordering import SPACES
from rowlens.functions.render import render
from rowlens.functions.text import looks_numeric
from rowlens.model import RAGGED, RID, ColumnInfo, Dialect, Format, Inferred, SourceError, TableSchema
from rowlens.sources import sniff
from rowlens.sources.arrays import element_groups
from rowlens.sources.ordinals import by_row_index, file_counts, rows_between
from rowlens.sources.records import Records, Rule, kept, numbered_anew, read_records

SAMPLE_RECORDS = 200
#: Most characters of a field of delimited text.
RECORD_CAP = 64 << 20

NO_ARRAY = "what was read is no JSON array"

_INTEGER = r"^[+-]?[0-9]+$"


@dataclass(frozen=True)
class Source:
    """An opened source.

    cells: the text of each column; extra: further fields of ragged records, if
    there can be any; rule and records: of text sources, what is known without
    reading them; parse: records (RID, value) as rows of data.
    """

    path: str
    format: Format
    data: DataFrame
    schema: TableSchema
    dialect: Dialect | None = None
    encoding: str = "utf-8"
    style: str = "spark"
    rule: Rule | None = None
    records: Records | None = None
    parse: Callable[[DataFrame], DataFrame] | None = None

    def between(self, start: int, end: int) -> DataFrame:
        """The rows with these ordinals; of an indexed text source, only their bytes are read."""
        local = self.records.window(start, end) if self.records and self.parse else None
        return self.parse(local) if local is not None else self.data.filter((F.col(RID) >= start) & (F.col(RID) < end))

    def cell(self, column: int) -> Column:
        """The text of a column; empty for one that the source doesn't have."""
        if not 0 <= column < len(self.schema):
            return F.lit("")
        name = f"c{column}"
        return render(F.col(name), self.data.schema[name].dataType, self.style)

    def cells(self) -> list[Column]:
        return [self.cell(c.id) for c in self.schema.columns]

    def ragged(self) -> Column:
        """Whether a record's width isn't the first one's."""
        return F.col(RAGGED).isNotNull() if RAGGED in self.data.columns else F.lit(False)

    def extra(self) -> Column | None:
        """Fields of a ragged record beyond the schema's, which a filter looks at, too."""
        if RAGGED not in self.data.columns or self.rule is None:
            return None
        q = self.rule.quote
        fields = F.transform(self.rule.fields(F.col(RAGGED)), lambda f: F.substr(f, F.lit(2)))
        plain = F.transform(fields, lambda f: F.when(f.startswith(q) & f.endswith(q) & (F.length(f) > 1), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit(q + q), F.lit(q))).otherwise(f))
        return F.when(F.col(RAGGED).isNotNull(), F.slice(plain, len(self.schema) + 1, 1 << 30))


def infer_types(data: DataFrame, cells: list[Column], most: int = SAMPLE_RECORDS) -> DataFrame:
    """One row per column (id, inferred), from the first records' text.

    Integer before float before boolean before text; empty cells say nothing.
    """
    first = data.filter(F.col(RID) < most)
    low = [F.btrim(c, F.lit(SPACES)) for c in cells]
    number = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

    def every(test: Column, t: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(t != "", test)), F.lit(False))

    kinds = []
    for i, t in enumerate(low):
        is_long = t.rlike(_INTEGER) & t.try_cast("long").isNotNull()
        kind = F.when(every(is_long, t), "integer").when(every(t.rlike(number), t), "float")
        kind = kind.when(every(F.lower(t).isin("true", "false"), t), "boolean").otherwise("text")
        kinds.append(F.struct(F.lit(i).alias("id"), kind.alias("inferred")))
    return first.agg(F.array(*kinds).alias("k")).select(F.explode("k").alias("k")).select("k.id", "k.inferred")


def _inferred(data: DataFrame, cells: list[Column]) -> list[Inferred]:
    if not cells:
        return []
    found = {r["id"]: Inferred(r["inferred"]) for r in infer_types(data, cells).collect()}  # a row per column
    return [found[i] for i in range(len(cells))]


def read_delimited(spark: SparkSession, path: str, dialect: Dialect | None = None, encoding: str | None = None) -> Source:
    """Delimited text. Every field is text.

    encoding "latin-1" keeps every byte of the source as one character, so that
    ``encode(c, 'ISO-8859-1')`` gives the exact bytes back and code point order
    is byte order.
    """
    head = sniff.read_head(spark, path)
    found, body = sniff.encoding_of(head)
    dialect = dialect or sniff.sniff_dialect(head)
    named = encoding or found
    sample = body.decode("utf-8" if named.startswith(("utf-16", "utf-8")) else named, "replace")
    first = sniff.records(sample, dialect.delimiter, 1, dialect.quote)
    names = first[0] if first else []
    spark_encoding = {"utf-16-le": "UTF-16", "utf-16-be": "UTF-16", "latin-1": "ISO-8859-1", "utf-8": "UTF-8"}.get(named, named)
    columns = [ColumnInfo(i, n if dialect.has_header else f"col{i}") for i, n in enumerate(names)]
    if not columns:
        empty = spark.createDataFrame([], T.StructType([T.StructField(RID, T.LongType())]))
        return Source(path, Format.DELIMITED, empty, TableSchema(), dialect, named)
    rule = Rule(dialect.delimiter, dialect.quote, len(columns))
    records = read_records(spark, path, spark_encoding, rule, dialect.has_header)
    parse = _delimited_parser(rule, columns)
    source = Source(path, Format.DELIMITED, parse(records.data), TableSchema(tuple(columns)), dialect, named, "spark", rule, records, parse)
    kinds = _inferred(source.between(0, SAMPLE_RECORDS), [F.col(c.field) for c in columns])
    return replace(source, schema=TableSchema(tuple(ColumnInfo(c.id, c.name, k) for c, k in zip(columns, kinds))))


def _delimited_parser(rule: Rule, columns: list[ColumnInfo]) -> Callable[[DataFrame], DataFrame]:
    options = {
        "sep": rule.delimiter, "quote": rule.quote, "escape": rule.quote, "mode": "PERMISSIVE", "multiLine": True, "emptyValue": "", "nullValue": "\0",
        "maxCharsPerColumn": RECORD_CAP, "maxColumns": max(20480, 2 * len(columns)), "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    schema = ", ".join(f"{c.field} string" for c in columns)

    def parse(records: DataFrame) -> DataFrame:
        row = F.from_csv("value", schema, {k: str(v) for k, v in options.items()})
        parsed = records.select(RID, "value", row.alias("row"))
        cells = [F.coalesce(F.col(f"row.{c.field}"), F.lit("")).alias(c.field) for c in columns]
        return parsed.select(RID, *cells, F.when(rule.ragged(F.col("value")), F.col("value")).alias(RAGGED))

    return parse


def _strict(raw: Column) -> Column:
    """A record's text if it is one JSON value and nothing else, else null.

    Spark's parser stops at a value's end and ignores what follows; in brackets
    the rest would be further elements, or an error.
    """
    t = F.btrim(raw, F.lit(SPACES))
    alone = F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")) == 1
    closed = F.when(t.startswith("{"), t.endswith("}")).when(t.startswith("["), t.endswith("]")).otherwise(F.lit(True))
    return F.when(alone & closed, t)


def _observe(acc: dict[str, bool], value) -> None:
    if value is None:
        return
    acc["any"] = True
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    acc["bool"] &= isinstance(value, bool)
    acc["float"] &= number
    acc["int"] &= isinstance(value, int) and number and -(1 << 63) <= value < 1 << 64


def _resolve(acc: dict[str, bool]) -> Inferred:
    if not acc["any"]:
        return Inferred.TEXT
    return Inferred.INTEGER if acc["int"] else Inferred.FLOAT if acc["float"] else Inferred.BOOLEAN if acc["bool"] else Inferred.TEXT


def json_columns(texts: list[str]) -> list[ColumnInfo]:
    """Columns of the sampled records: their keys in the order first seen, or one, value, if none is an object."""
    seen: dict[str, dict[str, bool]] = {}
    new = lambda: {"any": False, "int": True, "float": True, "bool": True}
    objects = False
    for text in texts:
        try:
            record = json.loads(text)
        except (ValueError, RecursionError):
            continue
        if isinstance(record, dict):
            objects = True
            for key, value in record.items():
                _observe(seen.setdefault(key, new()), value)
    if not objects:
        return [ColumnInfo(0, "value")]
    return [ColumnInfo(i, k, _resolve(acc)) for i, (k, acc) in enumerate(seen.items())]


def json_key_union(data: DataFrame, record: Column, most: int = SAMPLE_RECORDS) -> DataFrame:
    """The distinct top-level keys of the first records, in the order first seen: key, position."""
    keys = data.filter(F.col(RID) < most).select(RID, F.posexplode(F.json_object_keys(record)).alias("p", "key"))
    firsts = keys.groupBy("key").agg(F.min(F.struct(RID, "p")).alias("first"))
    from pyspark.sql import Window

    return firsts.select("key", (F.row_number().over(Window.orderBy("first")) - 1).alias("position"))  # at most the sample's keys


def _last_value(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e.key == F.lit(key)), F.lit(-1)).value


def json_fields(record: Column, keys: list[str]) -> list[Column]:
    """Fields of an object's text as cells: null or missing is empty, nested values are compact JSON, the last of equal keys counts."""
    t = F.btrim(record, F.lit(SPACES))
    whole = F.when(t.startswith("{"), t)
    if len({k.lower() for k in keys}) == len(keys):
        parsed = F.from_json(whole, T.StructType([T.StructField(k, T.StringType()) for k in keys]))
        found = [parsed.getField(k) for k in keys]
    else:  # names that differ in case only can't be told apart in a struct
        entries = F.map_entries(F.from_json(whole, "map<string,string>"))
        found = [_last_value(entries, k) for k in keys]
    return [F.coalesce(F.when(~v.isin('"Infinity"', '"-Infinity"'), v), F.lit("")) for v in found]


def json_field(record: Column, key: str) -> Column:
    return json_fields(record, [key])[0]


def _json_source(spark: SparkSession, path: str, fmt: Format, rows: DataFrame, encoding: str, records: Records | None = None) -> Source:
    """rows: RID, value."""
    first = records.window(0, SAMPLE_RECORDS) if records else None
    first = rows.filter(F.col(RID) < SAMPLE_RECORDS) if first is None else first
    sample = [r["value"] for r in first.orderBy(RID).select("value").collect()]
    columns = json_columns([s for s in sample if s is not None])
    if [c.name for c in columns] == ["value"] and not any((s or "").lstrip().startswith("{") for s in sample):
        whole = F.try_element_at(F.from_json(F.concat(F.lit("["), "strict", F.lit("]")), "array<string>"), F.lit(1))
        cells = [F.coalesce(whole if fmt is Format.JSON_LINES else F.col("value"), F.lit(""))]
        columns = [ColumnInfo(0, "value")]
    else:
        cells = json_fields(F.col("strict"), [c.name for c in columns])

    def parse(rows: DataFrame) -> DataFrame:
        return rows.withColumn("strict", _strict(F.col("value"))).select(RID, *[v.alias(c.field) for v, c in zip(cells, columns)])

    return Source(path, fmt, parse(rows), TableSchema(tuple(columns)), None, encoding, "spark", None, records, parse)


def read_json_lines(spark: SparkSession, path: str) -> Source:
    """One record per line; blank lines are none. A record that can't be parsed has empty cells."""
    encoding = sniff.encoding_of(sniff.read_head(spark, path))[0]
    records = read_records(spark, path, "UTF-16" if encoding.startswith("utf-16") else "UTF-8", Rule())
    return _json_source(spark, path, Format.JSON_LINES, records.data, encoding, records)


def _elements(spark: SparkSession, path: str, end: str) -> DataFrame:
    """RID and value of the elements of arrays, in order of RID within each part."""
    groups = element_groups(spark, path, end)
    rows = F.coalesce("rows", F.raise_error(F.lit(NO_ARRAY)).cast("array<string>"))
    found = numbered_anew(groups.select("_f", "_g", rows.alias("rows")))
    return found.select(F.col("_n").cast("long").alias(RID), "value").sortWithinPartitions(RID)


def read_json_array(spark: SparkSession, path: str) -> Source:
    """One top-level array per file; its elements are the records, numbered over all files. One that can't be parsed is an error.

    The elements are kept beside the indexes, so that a file is cut once.
    """
    head = sniff.encoding_of(sniff.read_head(spark, path))[1]
    objects = re.match(rb"\s*\[\s*\{", head)
    try:
        elements = kept(spark, path, ["array"], lambda: _elements(spark, path, "}" if objects else ","))
    except Exception as e:
        raise SourceError(f"{path} is no JSON array") if NO_ARRAY in str(e) else e
    between = lambda start, end: elements.filter((F.col(RID) >= start) & (F.col(RID) < end))
    return _json_source(spark, path, Format.JSON_ARRAY, elements, "utf-8", Records(elements, elements.count(), 0, between))


def _parquet_inferred(kind: T.DataType) -> Inferred:
    if isinstance(kind, T.BooleanType):
        return Inferred.BOOLEAN
    if isinstance(kind, T.IntegralType):
        return Inferred.INTEGER
    return Inferred.FLOAT if isinstance(kind, (T.FractionalType,)) else Inferred.TEXT


def read_parquet(spark: SparkSession, path: str, style: str = "spark") -> Source:
    """Parquet files; columns keep their types and are rendered as they are shown."""
    df = spark.read.parquet(path)
    schema = TableSchema(tuple(ColumnInfo(f.id, f.name, f.inferred) for f in (ColumnInfo(i, s.name, _parquet_inferred(s.dataType)) for i, s in enumerate(df.schema.fields))))
    numbered = by_row_index(df)
    fields = [F.col("`" + c.name.replace("`", "``") + "`").alias(c.field) for c in schema.columns]
    counts: list = []

    def window(start: int, end: int) -> DataFrame | None:
        if not counts:
            counts.append(file_counts(df))
        return rows_between(df, counts[0], start, end) if counts[0] else None

    records = Records(numbered, None, None, window)
    return Source(path, Format.PARQUET, numbered.select(RID, *fields), schema, None, "utf-8", style, None, records, lambda rows: rows.select(RID, *fields))


def open_source(spark: SparkSession, path: str, fmt: Format | None = None, dialect: Dialect | None = None, **options) -> Source:
    """Any source, its format detected unless given."""
    fmt = fmt or sniff.detect_format(spark, path)
    try:
        if fmt is Format.PARQUET:
            return read_parquet(spark, path, **options)
        if fmt is Format.JSON_LINES:
            return read_json_lines(spark, path)
        if fmt is Format.JSON_ARRAY:
            return read_json_array(spark, path)
        return read_delimited(spark, path, dialect, **options)
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"{path}: {e}") from e


def from_bytes(spark: SparkSession, raw: bytes, dialect: Dialect | None = None) -> Source:
    """Delimited text held in memory, without transcoding."""
    text = raw.decode("utf-8", "replace")
    dialect = dialect or sniff.sniff_dialect(raw)
    rows = sniff.records(text.removeprefix("﻿"), dialect.delimiter, -1, dialect.quote)
    width = len(rows[0]) if rows else 0
    names = rows[0] if dialect.has_header and rows else [f"col{i}" for i in range(width)]
    body = rows[1:] if dialect.has_header else rows
    d, q = dialect.delimiter, dialect.quote
    quoted = lambda f: q + f.replace(q, q + q) + q
    data = [(i, *(r + [""] * width)[:width], None if len(r) == width else d.join(map(quoted, r))) for i, r in enumerate(body)]
    schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(f"c{i}", T.StringType()) for i in range(width)), T.StructField(RAGGED, T.StringType())])
    df = spark.createDataFrame(data, schema)
    kinds = _inferred(df, [F.col(f"c{i}") for i in range(width)])
    return Source("", Format.DELIMITED, df, TableSchema(tuple(ColumnInfo(i, n, k) for i, (n, k) in enumerate(zip(names, kinds)))), dialect, rule=Rule(d, q, width))


__all__ = ["Source", "open_source", "from_bytes", "infer_types", "json_field", "json_key_union", "read_delimited", "read_json_array", "read_json_lines", "read_parquet", "looks_numeric"]
