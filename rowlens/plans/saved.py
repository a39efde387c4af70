"""What the user has set, and how it is kept between sessions."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from rowlens.functions.patterns import compile_filter
from rowlens.functions.text import stable_hash
from rowlens.model import Dialect, Direction, FilterSpec, InvalidPattern, SortKey, ViewSpec
from rowlens.operators.layout import GridLayout, RowSpan, next_sort

RECENT = 10


@dataclass
class ViewControls:
    search: str = ""
    regex: bool = False
    case_sensitive: bool = False
    invert: bool = False
    #: Hide rows without a match, rather than only mark the matches.
    filter_mode: bool = False
    sort: SortKey | None = None
    selected: RowSpan | None = None

    def desired(self) -> ViewSpec:
        """The view that the controls stand for: no filter without a query or in highlight mode."""
        on = self.filter_mode and self.search
        return ViewSpec(FilterSpec(self.search, self.regex, self.invert, self.case_sensitive) if on else None, self.sort)

    def highlight(self, spark=None) -> FilterSpec | None:
        """What to mark: never inverted; None without a query or while the pattern is invalid."""
        if not self.search:
            return None
        spec = FilterSpec(self.search, self.regex, False, self.case_sensitive)
        try:
            compile_filter(spec, spark)
        except InvalidPattern:
            return None
        return spec

    def click_header(self, column: int) -> None:
        self.sort = next_sort(self.sort, column)

    def reset(self, layout: GridLayout | None = None) -> None:
        """All back to the start, but for case sensitivity, which is a preference."""
        self.__dict__.update(ViewControls(case_sensitive=self.case_sensitive).__dict__)
        if layout is not None:
            layout.reset()


@dataclass
class SavedView:
    """A file's layout, sort and filter."""

    order: list[int] = field(default_factory=list)
    visible: list[bool] = field(default_factory=list)
    sort: tuple[int, bool] | None = None
    filter: tuple[str, bool, bool] | None = None
    case_sensitive: bool = False
    #: Set by the user; None: detected.
    delimiter: str | None = None

    @classmethod
    def snapshot(cls, layout: GridLayout, controls: ViewControls, delimiter: str | None = None) -> SavedView:
        spec = controls.desired()
        return cls(
            list(layout.order),
            list(layout.visible),
            (spec.sort.column, spec.sort.direction is Direction.ASCENDING) if spec.sort else None,
            (spec.filter.query, spec.filter.regex, spec.filter.invert) if spec.filter else None,
            controls.case_sensitive,
            delimiter,
        )

    def apply(self, layout: GridLayout, controls: ViewControls) -> list[str]:
        """Puts what still fits onto a newly opened table; returns what didn't."""
        n, dropped = len(layout.order), []
        if sorted(self.order) == list(range(n)):
            layout.order = list(self.order)
        else:
            dropped.append("column order")
        if len(self.visible) == n:
            layout.visible = list(self.visible)
        else:
            dropped.append("column visibility")
        if self.sort and 0 <= self.sort[0] < n:
            controls.sort = SortKey(self.sort[0], Direction.ASCENDING if self.sort[1] else Direction.DESCENDING)
        elif self.sort:
            dropped.append("sort")
        controls.case_sensitive = self.case_sensitive
        if self.filter:
            controls.search, controls.regex, controls.invert = self.filter
            controls.filter_mode = True
        return dropped

    def dialect(self, detected: Dialect) -> Dialect:
        """The dialect to open with."""
        return Dialect(self.delimiter, detected.quote, detected.has_header) if self.delimiter else detected

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> SavedView:
        raw = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**raw | {k: tuple(raw[k]) for k in ("sort", "filter") if raw.get(k)})


class Store:
    """Saved views and recent files, as small files in one folder."""

    def __init__(self, folder: str | os.PathLike | None = None):
        self.folder = Path(folder or os.environ.get("ROWLENS_HOME") or Path.home() / ".config" / "rowlens")

    def _view(self, source: str) -> Path:
        return self.folder / "views" / f"{stable_hash(source):016x}.json"

    def _write(self, path: Path, text: str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        new = path.with_name(path.name + ".new")
        new.write_text(text)
        new.replace(path)

    def save_view(self, source: str, view: SavedView) -> None:
        self._write(self._view(source), view.dumps())

    def load_view(self, source: str) -> SavedView | None:
        try:
            return SavedView.loads(self._view(source).read_text())
        except (OSError, ValueError, TypeError):
            return None

    def recent(self) -> list[str]:
        try:
            return (self.folder / "recent.txt").read_text().splitlines()
        except OSError:
            return []

    def add_recent(self, source: str) -> list[str]:
        found = [source, *(s for s in self.recent() if s != source)][:RECENT]
        self._write(self.folder / "recent.txt", "\n".join(found))
        return found

    def clear_recent(self) -> None:
        (self.folder / "recent.txt").unlink(missing_ok=True)

    def size(self) -> int:
        return sum(p.stat().st_size for p in self.folder.rglob("*") if p.is_file())

    def clear(self) -> None:
        for p in self.folder.rglob("*"):
            if p.is_file():
                p.unlink()
