"""Column order and visibility, row spans, and the cursor: plain values, no data."""

from __future__ import annotations

from dataclasses import dataclass, field

from rowlens.model import Direction, SortKey

PAGE_ROWS = 20


def reorder(order: list[int], dragged: int, target: int, after: bool = False) -> list[int]:
    """order with dragged moved next to target; unchanged if it isn't there, at the end if target isn't."""
    if dragged == target or dragged not in order:
        return list(order)
    rest = [c for c in order if c != dragged]
    at = rest.index(target) + after if target in rest else len(rest)
    return [*rest[:at], dragged, *rest[at:]]


@dataclass
class GridLayout:
    """All source columns in display order, and which of them are shown."""

    order: list[int]
    visible: list[bool] = field(default_factory=list)

    @classmethod
    def of(cls, columns: int) -> GridLayout:
        return cls(list(range(columns)), [True] * columns)

    def reopened(self, columns: int) -> GridLayout:
        """For the same file read otherwise: this layout if there are as many columns as before, else a new one."""
        return GridLayout(list(self.order), list(self.visible)) if columns == len(self.order) else GridLayout.of(columns)

    def displayed(self) -> list[int]:
        return [c for c in self.order if self.visible[c]]

    def move(self, dragged: int, target: int, after: bool = False) -> None:
        self.order = reorder(self.order, dragged, target, after)

    def reset(self) -> None:
        self.order, self.visible = list(range(len(self.order))), [True] * len(self.order)


@dataclass(frozen=True)
class RowSpan:
    """An inclusive span of display rows; lead is the end that moves."""

    anchor: int
    lead: int

    @classmethod
    def single(cls, row: int) -> RowSpan:
        return cls(row, row)

    @property
    def lo(self) -> int:
        return min(self.anchor, self.lead)

    @property
    def hi(self) -> int:
        return max(self.anchor, self.lead)

    def __contains__(self, row: int) -> bool:
        return self.lo <= row <= self.hi

    def __len__(self) -> int:
        return self.hi - self.lo + 1


def next_sort(current: SortKey | None, column: int) -> SortKey | None:
    """What a click on a column's header makes of the sort: ascending, descending, none."""
    if current is None or current.column != column:
        return SortKey(column)
    return SortKey(column, Direction.DESCENDING) if current.direction is Direction.ASCENDING else None


#: Moves of the cursor: from (row or None, last row) to the new row.
_MOVES = {
    "down": lambda r, last: 0 if r is None else min(r + 1, last),
    "up": lambda r, last: 0 if r is None else max(r - 1, 0),
    "page_down": lambda r, last: 0 if r is None else min(r + PAGE_ROWS, last),
    "page_up": lambda r, last: 0 if r is None else max(r - PAGE_ROWS, 0),
    "home": lambda r, last: 0,
    "end": lambda r, last: last,
}


def move(selected: RowSpan | None, key: str, total: int, extend: bool = False) -> RowSpan | None:
    """The selection after a key; with extend, from the same anchor."""
    if total == 0:
        return selected
    row = _MOVES[key](selected.lead if selected else None, total - 1)
    return RowSpan(selected.anchor, row) if extend and selected else RowSpan.single(row)


def find_start(selected: RowSpan | None, forward: bool, total: int) -> int | None:
    """Where a search for the next or previous match begins; None if there is nothing to search."""
    if total == 0:
        return None
    if selected is None:
        return 0 if forward else total - 1
    if forward:
        return selected.lead + 1
    return selected.lead - 1 if selected.lead else None
