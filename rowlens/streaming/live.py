"""A view that is built in the background and shown when it is ready."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.model import RID, RowCount, RowRange, Viewport, ViewSpec, ViewStatus
from rowlens.operators.view import TableView
from rowlens.sources.ordinals import positions, release
from rowlens.streaming.jobs import CancellationToken, Job, Progress, Slot

#: Rows of a window that are asked for by a list of ordinals.
MOST_LISTED = 4096


@dataclass(frozen=True)
class _Shown:
    """A view and, if it has a filter or a sort, the ordinals of its rows with their positions, kept, and their number."""

    view: TableView
    at: DataFrame | None = None
    n: int | None = None


class LiveView:
    """Shows one view of a source while the next one is built.

    set_view refuses an invalid one at once, and what is shown stays. Otherwise
    it cancels what is being built; a view without filter and sort is shown at
    once, any other when its rows are numbered. A build that was superseded,
    cancelled or that failed shows nothing. The last window is remembered.
    """

    def __init__(self, view: TableView):
        self._spark = view.source.data.sparkSession
        self._slot = Slot(self._spark)
        self._lock = threading.Lock()
        self._shown = _Shown(view.cleared())
        self._last: tuple | None = None
        if not view.spec.is_identity:
            self.set_view(view.spec)

    @property
    def view(self) -> TableView:
        """What is shown."""
        return self._shown.view

    def set_view(self, spec: ViewSpec) -> Job | None:
        """Shows the source so, now or when it is built; the job that builds it, if there is one."""
        wanted = self._shown.view.with_spec(spec)
        with self._lock:  # a build is shown or cancelled, not both
            self._slot.clear()
        if spec.is_identity:
            self._show(_Shown(wanted))
            return None
        return self._slot.submit(lambda token: self._build(wanted, token))

    def clear_view(self) -> None:
        self.set_view(ViewSpec())

    def _build(self, wanted: TableView, token: CancellationToken) -> int:
        at = None
        try:
            at = positions(wanted.rows(), wanted.order(), columns=[F.col(RID)])
            made = _Shown(wanted, at, at.count())
            self._show(made, token)
        except BaseException:
            if at is not None:
                release(at)
            raise
        return made.n

    def _show(self, made: _Shown, token: CancellationToken | None = None) -> None:
        with self._lock:
            if token is not None:
                token.check()
            before, self._shown, self._last = self._shown, made, None
        if before.at is not None:
            release(before.at)

    def close(self) -> None:
        """Cancels what is being built and gives up what is kept."""
        self.clear_view()

    def status(self) -> ViewStatus:
        return self._slot.status()

    def progress(self) -> Progress:
        """Tasks of what is being built, or was built last."""
        return self._slot.job.progress() if self._slot.job else Progress(0, 0, 0)

    def wait(self, timeout: float | None = None) -> None:
        """Until nothing is being built; raises what the build raised."""
        job = self._slot.job
        if job is not None:
            job.result(timeout)

    def row_count(self) -> RowCount:
        shown = self._shown
        return RowCount(shown.view.count() if shown.n is None else shown.n)

    def fetch(self, rows: RowRange, columns: Sequence[int] | None = None) -> Viewport:
        """The window's cells of what is shown, whatever is being built; fewer rows than asked for at its end."""
        with self._lock:
            shown, last = self._shown, self._last
        key = (rows, None if columns is None else tuple(columns))
        if last is not None and last[0] == key:
            return Viewport([list(r) for r in last[1]])
        if shown.at is None:
            found = shown.view.fetch(rows, columns).rows
        else:
            some = shown.at.filter((F.col("view_pos") >= rows.start) & (F.col("view_pos") < rows.start + rows.len))
            if rows.len <= MOST_LISTED:  # their ordinals reach the scan
                found = shown.view.fetch_rows([r[RID] for r in some.orderBy("view_pos").collect()], columns).rows
            else:
                cells = shown.view.cleared().project(columns).join(some, RID).orderBy("view_pos").drop("view_pos")
                found = [list(r)[1:] for r in cells.collect()]
        with self._lock:
            if self._shown is shown:
                self._last = (key, [list(r) for r in found])
        return Viewport(found)
