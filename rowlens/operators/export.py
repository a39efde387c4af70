"""Exports: CSV, TSV, NDJSON and Parquet, of a view or of its whole source.

Rows are written by all tasks, in order from file to file, into a folder that
appears under its name only when it is complete. single_file joins the parts
into one file on the way, byte by byte, through the driver.
"""

from __future__ import annotations

import enum
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.text import export_names, raw_name
from rowlens.model import RID, Dialect, ViewSpec
from rowlens.operators.view import TableView


class Scope(enum.Enum):
    CURRENT_VIEW = "view"
    SOURCE = "source"


class ExportKind(enum.Enum):
    CSV = "csv"
    TSV = "tsv"
    NDJSON = "ndjson"
    PARQUET = "parquet"


def _scoped(view: TableView, scope: Scope, columns: Sequence[int] | None) -> tuple[TableView, list[int]]:
    if scope is Scope.SOURCE:
        return TableView(view.source, ViewSpec()), list(range(len(view.source.schema)))
    return view, list(range(len(view.source.schema)) if columns is None else columns)


def csv_field(cell: Column, delimiter: str, quote: str = '"') -> Column:
    """A cell, quoted only if it must be."""
    special = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in (delimiter, quote, "\r", "\n")) + "]"
    return F.when(cell.rlike(special), F.concat(F.lit(quote), F.replace(cell, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(cell)


def csv_line(cells: Sequence[Column], delimiter: str) -> Column:
    """A record; one of a single empty cell is quoted, as a blank line would be none."""
    line = F.concat_ws(delimiter, *[csv_field(c, delimiter) for c in cells])
    return F.when(line == "", '""').otherwise(line) if len(cells) == 1 else line


def csv_lines(view: TableView, columns: Sequence[int], delimiter: str, header: Sequence[str] | None) -> DataFrame:
    """line, in order; the header, if any, comes first."""
    rows = view.ordered(columns)
    lines = rows.select(csv_line([F.col(c) for c in rows.columns if c != RID], delimiter).alias("line"))
    if header is None:
        return lines
    first = view.source.data.sparkSession.createDataFrame([tuple(header)], [f"h{i}" for i in range(len(header))])
    return first.select(csv_line([F.col(f"h{i}") for i in range(len(header))], delimiter).alias("line")).union(lines)


def json_lines(view: TableView, columns: Sequence[int]) -> DataFrame:
    """line, in order: an object per row whose values are all strings; of columns with one name, the last counts."""
    names = export_names(view.source.schema, list(columns))
    last = {n: f"v{i}" for i, n in enumerate(names)}
    rows = view.ordered(columns)
    return rows.select(F.to_json(F.struct(*[F.col(v).alias(n) for n, v in last.items()]), {"ignoreNullFields": "false"}).alias("line"))


def text_table(view: TableView, columns: Sequence[int]) -> DataFrame:
    """All cells as strings under their export names, in order; a repeated name gets a number."""
    out, seen = [], set()
    for n in export_names(view.source.schema, list(columns)):
        unique, k = n, 2
        while unique.lower() in seen:
            unique, k = f"{n}_{k}", k + 1
        seen.add(unique.lower())
        out.append(unique)
    rows = view.ordered(columns)
    return rows.select(*[F.col(f"v{i}").alias(n) for i, n in enumerate(out)])


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: In a folder that an export made: such a folder, and no other, may be replaced by the next export.
STAMP = "_rowlens_export"


def _check_target(spark, target: str, source: str) -> None:
    """Refuses a target that holds anything but an earlier export, or the source itself."""
    jvm, to, fs = _fs(spark, target)
    if source:
        _, own, _ = _fs(spark, source)
        own, there = (fs.makeQualified(p).toString().rstrip("/") + "/" for p in (own, to))
        if own.startswith(there) or there.startswith(own):
            raise FileExistsError(f"{target} is the source's own place")
    if fs.exists(to) and fs.getFileStatus(to).isDirectory() and len(fs.listStatus(to)) and not fs.exists(jvm.org.apache.hadoop.fs.Path(to, STAMP)):
        raise FileExistsError(f"{target} is a folder that no export made")


def _publish(spark, made: str, target: str, single_file: bool) -> None:
    """Moves a finished folder, or the joined bytes of its parts, to the target's name; what was there goes only when that has worked."""
    jvm, source, fs = _fs(spark, made)
    _, to, _ = _fs(spark, target)
    if single_file:
        joined = jvm.org.apache.hadoop.fs.Path(made + ".joined")
        out = fs.create(joined)
        try:
            for part in sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
        fs.delete(source, True)
        source = joined
    else:
        fs.create(jvm.org.apache.hadoop.fs.Path(source, STAMP)).close()
    aside = jvm.org.apache.hadoop.fs.Path(made + ".old")
    replaced = fs.exists(to)
    if replaced and not fs.rename(to, aside):
        raise OSError(f"{target} can't be replaced")
    if not fs.rename(source, to):
        if replaced:
            fs.rename(aside, to)
        raise OSError(f"{made} can't be renamed to {target}")
    fs.delete(aside, True)


def export(
    view: TableView,
    path: str,
    kind: ExportKind,
    scope: Scope = Scope.CURRENT_VIEW,
    columns: Sequence[int] | None = None,
    single_file: bool = False,
) -> None:
    """Writes the export under path; on failure what was there before stays.

    CSV and TSV have a header if the source had one. A file, or a folder that
    an earlier export made, is replaced; any other folder is refused.
    """
    view, columns = _scoped(view, scope, columns)
    spark = view.source.data.sparkSession
    _check_target(spark, path, view.source.path)
    parent, _, name = path.rstrip("/").rpartition("/")
    made = f"{parent}/.{name}.{uuid.uuid4().hex}" if parent else f".{name}.{uuid.uuid4().hex}"
    try:
        if kind is ExportKind.PARQUET:
            table = text_table(view, columns)
            (table.coalesce(1) if single_file else table).write.parquet(made)
        else:
            if kind is ExportKind.NDJSON:
                lines = json_lines(view, columns)
            else:
                dialect = view.source.dialect or Dialect()
                header = [raw_name(view.source.schema, c) for c in columns] if dialect.has_header else None
                lines = csv_lines(view, columns, "\t" if kind is ExportKind.TSV else ",", header)
            lines.write.option("lineSep", "\n").text(made)
        _publish(spark, made, path, single_file)
    finally:
        for left in (made, made + ".joined"):
            jvm, where, fs = _fs(spark, left)
            fs.delete(where, True)
