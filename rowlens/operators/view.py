"""A table seen through a filter and a sort.

A view is a source and a ViewSpec; nothing runs until rows, a count or a match
are asked for, and nothing is installed, so nothing can go stale. Filter and
sort become one Catalyst plan over the source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.ordering import order_by
from rowlens.functions.patterns import compile_filter
from rowlens.functions.predicates import any_matches, cell_matches, row_filter
from rowlens.model import RID, DataQuality, Dialect, FilterSpec, RowCount, RowRange, SortKey, Viewport, ViewSpec
from rowlens.operators.layout import RowSpan
from rowlens.sources.ordinals import keeping, positions, release
from rowlens.sources.readers import Source

#: Rows to which a window of a sorted view is cut out of a top-k; beyond, positions are numbered.
SHALLOW = 100_000
MOST_COPIED = 1_000_000


@dataclass(frozen=True)
class TableView:
    source: Source
    spec: ViewSpec = field(default_factory=ViewSpec)

    # The view's definition

    def with_spec(self, spec: ViewSpec) -> TableView:
        """The same source seen otherwise. An invalid pattern or column is refused here, and this view stays as it is."""
        if spec.filter is not None:
            compile_filter(spec.filter, self.source.data.sparkSession)
        if spec.sort is not None and not 0 <= spec.sort.column < len(self.source.schema):
            raise ValueError(f"there is no column {spec.sort.column}")
        return replace(self, spec=spec)

    def filtered(self, query: str, **flags) -> TableView:
        return self.with_spec(replace(self.spec, filter=FilterSpec(query, **flags)))

    def sorted(self, key: SortKey | None) -> TableView:
        return self.with_spec(replace(self.spec, sort=key))

    def cleared(self) -> TableView:
        return replace(self, spec=ViewSpec())

    def reopened(self, dialect: Dialect) -> TableView:
        """The same delimited file read otherwise, under the same filter, and the same sort if it still has that column."""
        from rowlens.sources.readers import read_delimited

        s = self.source
        again = TableView(read_delimited(s.data.sparkSession, s.path, dialect, s.encoding))
        key = self.spec.sort
        return again.with_spec(replace(self.spec, sort=key if key is None or key.column < len(again.source.schema) else None))

    def rows(self) -> DataFrame:
        """The source's rows that the filter keeps, in no order."""
        s, f = self.source, self.spec.filter
        return s.data if f is None else s.data.filter(row_filter(s.cells(), f, s.data.sparkSession, s.extra()))

    def order(self) -> list[Column]:
        """Sort columns of the view; ties and unsorted views are in source order."""
        key = self.spec.sort
        if key is None:
            return [F.col(RID).asc()]
        s = self.source
        return order_by(F.col(f"c{key.column}"), s.cell(key.column), s.data.schema[f"c{key.column}"].dataType, key.direction)

    def _columns(self, columns: Sequence[int] | None) -> list[Column]:
        """Cells of the columns asked for, in that order; repeats are fine, unknown columns are empty."""
        ids = range(len(self.source.schema)) if columns is None else columns
        return [self.source.cell(c).alias(f"v{i}") for i, c in enumerate(ids)]

    # Rows

    def project(self, columns: Sequence[int] | None = None) -> DataFrame:
        """RID and v0..vN, in no order."""
        return self.rows().select(RID, *self._columns(columns))

    def ordered(self, columns: Sequence[int] | None = None) -> DataFrame:
        """RID and v0..vN, in the view's order."""
        return self.rows().orderBy(*self.order()).select(RID, *self._columns(columns))

    def numbered(self, columns: Sequence[int] | None = None) -> DataFrame:
        """RID, v0..vN and view_pos, the row's position in the view from 0."""
        if self.spec.is_identity:
            return self.project(columns).withColumn("view_pos", F.col(RID))
        return positions(self.rows(), self.order(), columns=[F.col(RID), *self._columns(columns)])

    def window(self, rows: RowRange, columns: Sequence[int] | None = None) -> DataFrame:
        """The view's rows from rows.start on, at most rows.len of them: RID, v0..vN, in order."""
        start, end = rows.start, rows.start + rows.len
        if self.spec.is_identity:  # on Parquet, the bounds reach the scan
            return self.source.between(start, end).select(RID, *self._columns(columns)).orderBy(RID)
        if end <= SHALLOW:
            return self.rows().orderBy(*self.order()).select(RID, *self._columns(columns)).offset(start).limit(rows.len)
        found = self.placed(rows, columns)
        return keeping(found.orderBy("view_pos").drop("view_pos"), found)

    def placed(self, rows: RowRange, columns: Sequence[int] | None = None) -> DataFrame:
        """As window, with view_pos and in no order: only keys and ordinals are sorted, the window's rows are fetched by ordinal."""
        at = positions(self.rows(), self.order(), columns=[F.col(RID)])
        some = at.filter((F.col("view_pos") >= rows.start) & (F.col("view_pos") < rows.start + rows.len))
        return keeping(self.source.data.select(RID, *self._columns(columns)).join(some, RID), at)

    def fetch(self, rows: RowRange, columns: Sequence[int] | None = None) -> Viewport:
        """The window's cells; fewer rows than asked for at the end of the view."""
        found = self.window(rows, columns)
        cells = [list(r)[1:] for r in found.collect()]
        release(found)
        return Viewport(cells)

    def fetch_source(self, rows: RowRange, columns: Sequence[int] | None = None) -> Viewport:
        """As fetch, whatever the view."""
        return self.cleared().fetch(rows, columns)

    def fetch_rows(self, ordinals: Sequence[int], columns: Sequence[int] | None = None) -> Viewport:
        """Source rows by ordinal, in the order asked for; repeats are fine, unknown ones are blank."""
        wanted = sorted(set(ordinals))
        found = {r[0]: list(r)[1:] for r in self.source.data.filter(F.col(RID).isin(wanted)).select(RID, *self._columns(columns)).collect()}
        blank = [""] * (len(self.source.schema) if columns is None else len(columns))
        return Viewport([found.get(i, blank) for i in ordinals])

    def batches(self, size: int = 1024, columns: Sequence[int] | None = None) -> Iterator[list[list[str]]]:
        """All rows in order, a batch at a time; the driver holds one partition."""
        held: list[list[str]] = []
        for r in self.ordered(columns).toLocalIterator():
            held.append(list(r)[1:])
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def count(self) -> int:
        if self.spec.filter is None and self.source.records and self.source.records.n_records is not None:
            return self.source.records.n_records
        return self.rows().count()

    def row_count(self) -> RowCount:
        return RowCount(self.count())

    def data_quality(self) -> DataQuality:
        """Records whose width isn't the first one's; only delimited text has any."""
        if self.source.records and self.source.records.n_ragged is not None:
            return DataQuality(self.source.records.n_ragged)
        return DataQuality(self.source.data.agg(F.count(F.when(self.source.ragged(), 1))).first()[0])

    # Matches

    def highlights(self, spec: FilterSpec, columns: Sequence[int] | None = None) -> DataFrame:
        """RID and m0..mN: whether each cell matches, inverted or not."""
        ids = range(len(self.source.schema)) if columns is None else columns
        flags = [cell_matches(self.source.cell(c), spec, self.source.data.sparkSession).alias(f"m{i}") for i, c in enumerate(ids)]
        return self.rows().select(RID, *flags)

    def matches(self, spec: FilterSpec, columns: Sequence[int]) -> DataFrame:
        """view_pos of every row with a match in the columns."""
        hit = any_matches([self.source.cell(c) for c in columns], spec, self.source.data.sparkSession)
        if self.spec.is_identity:
            return self.source.data.filter(hit).select(F.col(RID).alias("view_pos"))
        at = positions(self.rows(), self.order(), columns=[hit.alias("hit")])
        return keeping(at.filter("hit").select("view_pos"), at)

    def find(self, spec: FilterSpec, columns: Sequence[int], first: int, forward: bool = True) -> int | None:
        """Position of the nearest row with a match in the columns, from first on towards an end; None at the end."""
        if not spec.query or first < 0:
            return None
        if not forward and first >= self.count():
            return None
        found = self.matches(spec, columns)
        if forward:
            at = found.filter(F.col("view_pos") >= first).agg(F.min("view_pos")).first()[0]
        else:
            at = found.filter(F.col("view_pos") <= first).agg(F.max("view_pos")).first()[0]
        release(found)
        return at

    # Text

    def lines(self, columns: Sequence[int] | None = None) -> DataFrame:
        """RID and line, the cells with tabs between them, unquoted; in no order."""
        return self.project(columns).select(RID, F.concat_ws("\t", *[c for c in self._names(columns)]).alias("line"))

    def _names(self, columns: Sequence[int] | None) -> list[str]:
        return [f"v{i}" for i in range(len(self.source.schema) if columns is None else len(columns))]

    def copy_cell(self, row: int, column: int) -> str:
        """A cell of the view, unquoted; empty beyond its end."""
        return self.copy_text(RowRange(row, 1), [column])

    def copy_row(self, row: int, columns: Sequence[int] | None = None) -> str:
        return self.copy_text(RowRange(row, 1), columns)

    def copy_selection(self, span: RowSpan, columns: Sequence[int] | None = None) -> str:
        """The rows of a span of the view, in order; both its ends count."""
        return self.copy_text(RowRange(span.lo, len(span)), columns)

    def copy_text(self, rows: RowRange, columns: Sequence[int] | None = None) -> str:
        """The window's rows as tab-separated lines, at most MOST_COPIED of them."""
        rows = RowRange(rows.start, min(rows.len, MOST_COPIED))
        return "\n".join("\t".join(r) for r in self.fetch(rows, columns).rows)

    def create_view(self, name: str) -> None:
        """For SQL: the rows of the view, columns by their names where these are unique."""
        names = self.source.schema.names()
        unique = [n if n and names.count(n) == 1 else f"c{i}" for i, n in enumerate(names)]
        self.rows().select(*[self.source.cell(i).alias(n) for i, n in enumerate(unique)]).createOrReplaceTempView(name)


def open_view(spark, path: str, **options) -> TableView:
    from rowlens.sources.readers import open_source

    return TableView(open_source(spark, path, **options))


def column_stats(view: TableView) -> DataFrame:
    """Of each column of the view: id, least and greatest cell by the sort order, distinct cells, empty cells."""
    from rowlens.functions.ordering import sort_key

    cell = F.col("cell")
    cells = view.rows().select(F.posexplode(F.array(*view.source.cells())).alias("id", "cell"))  # one scan for all columns
    one = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_key(cell))], "cell")
    return cells.groupBy("id").agg(
        F.min(one)["cell"].alias("least"), F.max(one)["cell"].alias("greatest"), F.countDistinct("cell").alias("n_distinct"), F.count(F.when(cell == "", 1)).alias("n_empty")
    )
