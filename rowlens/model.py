"""The data model: tables of text cells in source order, and the one kind of query over them."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

#: Ordinal of a record in its source, from 0; the identity of a row and the tie-break of every sort.
RID = "__rid"
#: Raw text of a delimited record whose width differs from the schema's, else null.
RAGGED = "__ragged"


class RowlensError(Exception):
    """Base of all errors of this package. Malformed data is not an error."""


class SourceError(RowlensError):
    """A source can't be opened."""


class Cancelled(RowlensError):
    """A job was cancelled."""


class InvalidPattern(RowlensError):
    """A search pattern isn't valid."""


class Inferred(enum.Enum):
    """Presentational type of a column; it never alters cells or their order."""

    TEXT = "text"
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"


class Format(enum.Enum):
    DELIMITED = "delimited"
    JSON_LINES = "json lines"
    JSON_ARRAY = "json array"
    PARQUET = "parquet"


class Direction(enum.Enum):
    ASCENDING = "ascending"
    DESCENDING = "descending"


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    has_header: bool = True

    def __post_init__(self):
        if len(self.delimiter) != 1 or len(self.quote) != 1:
            raise ValueError("delimiter and quote are single characters")


@dataclass(frozen=True)
class ColumnInfo:
    """A source column. id is its position; name is as in the source, with any byte order mark."""

    id: int
    name: str
    inferred: Inferred = Inferred.TEXT

    @property
    def field(self) -> str:
        """Its physical name: source names may repeat or be empty."""
        return f"c{self.id}"


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnInfo, ...] = ()

    def __len__(self) -> int:
        return len(self.columns)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]


@dataclass(frozen=True)
class FilterSpec:
    """Keep rows in which any field matches, or, inverted, none does."""

    query: str
    regex: bool = False
    invert: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class SortKey:
    column: int
    direction: Direction = Direction.ASCENDING


@dataclass(frozen=True)
class ViewSpec:
    """The whole query: an optional filter, then an optional sort."""

    filter: FilterSpec | None = None
    sort: SortKey | None = None

    @property
    def is_identity(self) -> bool:
        return self.filter is None and self.sort is None


@dataclass(frozen=True)
class RowRange:
    start: int
    len: int

    def __post_init__(self):
        if self.start < 0 or self.len < 0:
            raise ValueError("a row range has no negative bounds")


@dataclass(frozen=True)
class Viewport:
    """Materialised cells, row by row."""

    rows: list[list[str]] = field(default_factory=list)


@dataclass(frozen=True)
class RowCount:
    n: int
    exact: bool = True


@dataclass(frozen=True)
class DataQuality:
    ragged_rows: int
    complete: bool = True


@dataclass(frozen=True)
class ViewStatus:
    building: bool = False
