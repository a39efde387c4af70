import threading

import pytest

from rowlens.model import Cancelled, FilterSpec, RowRange, SortKey, ViewSpec
from rowlens.operators.view import open_view
from rowlens.streaming import live
from rowlens.streaming.live import LiveView


@pytest.fixture
def source(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,w\n" + "".join(f"{i},{'xyz'[i % 3]}{i * 7 % 50}\n" for i in range(300)))
    return open_view(spark, str(tmp_path / "t.csv"))


SPEC = ViewSpec(FilterSpec("y"), SortKey(1))


@pytest.mark.parametrize("most", [4096, 3])
def test_a_built_view_is_the_view(source, monkeypatch, most):
    monkeypatch.setattr(live, "MOST_LISTED", most)
    v = LiveView(source)
    assert v.row_count().n == 300 and not v.status().building
    v.set_view(SPEC).result(120)
    plain = source.with_spec(SPEC)
    assert v.view.spec == SPEC and v.row_count().n == plain.count() == 100
    for rows, columns in ((RowRange(0, 5), None), (RowRange(90, 20), [1, 0, 1, 9]), (RowRange(100, 5), None), (RowRange(7, 0), None)):
        assert v.fetch(rows, columns).rows == plain.fetch(rows, columns).rows
    v.clear_view()
    assert v.view.spec.is_identity and v.fetch(RowRange(298, 9)).rows == source.fetch(RowRange(298, 9)).rows


def test_what_is_invalid_changes_nothing(source):
    v = LiveView(source.with_spec(SPEC))
    v.wait(120)
    for bad in (ViewSpec(FilterSpec("(", regex=True)), ViewSpec(None, SortKey(7))):
        with pytest.raises(Exception):
            v.set_view(bad)
        assert v.view.spec == SPEC and v.row_count().n == 100
    v.close()


def test_a_superseded_build_shows_nothing(source, monkeypatch):
    held, numbered = threading.Event(), live.positions

    def slow(*args, **options):
        at = numbered(*args, **options)
        held.wait(60)
        return at

    monkeypatch.setattr(live, "positions", slow)
    v = LiveView(source)
    first = v.set_view(ViewSpec(FilterSpec("x")))
    assert v.status().building and v.view.spec.is_identity  # the old view is shown meanwhile
    assert v.fetch(RowRange(0, 1)).rows == [["0", "x0"]]
    second = v.set_view(SPEC)
    held.set()
    with pytest.raises(Cancelled):
        first.result(120)
    second.result(120)
    assert v.view.spec == SPEC and not v.status().building and v.progress().tasks > 0
    third = v.set_view(ViewSpec(FilterSpec("z")))
    v.close()
    with pytest.raises(Cancelled):
        third.result(120)
    assert v.view.spec.is_identity


def test_a_failed_build_shows_nothing(source, monkeypatch):
    v = LiveView(source)
    monkeypatch.setattr(live, "positions", lambda *a, **o: 1 / 0)
    v.set_view(SPEC)
    with pytest.raises(ZeroDivisionError):
        v.wait(60)
    assert v.view.spec.is_identity and v.row_count().n == 300


def test_the_last_window_is_remembered(source, monkeypatch):
    v = LiveView(source)
    first = v.fetch(RowRange(3, 2)).rows
    first[0][0] = "changed"  # a caller's own
    monkeypatch.setattr(type(source), "fetch", lambda *a: 1 / 0)
    assert v.fetch(RowRange(3, 2)).rows == [["3", "x21"], ["4", "y28"]]
    with pytest.raises(ZeroDivisionError):
        v.fetch(RowRange(3, 2), [0])
    monkeypatch.undo()
    v.set_view(SPEC).result(120)
    assert v.fetch(RowRange(3, 2)).rows == source.with_spec(SPEC).fetch(RowRange(3, 2)).rows
    v.close()
