import pytest

from rowlens.model import Dialect, Direction, FilterSpec, SortKey, ViewSpec
from rowlens.operators.layout import GridLayout, RowSpan, find_start, move, next_sort, reorder
from rowlens.plans.saved import SavedView, Store, ViewControls


def test_reorder():
    assert reorder([0, 1, 2, 3], 3, 1) == [0, 3, 1, 2]
    assert reorder([0, 1, 2, 3], 0, 2, True) == [1, 2, 0, 3]
    assert reorder([0, 1], 1, 1) == [0, 1]
    assert reorder([0, 1], 5, 1) == [0, 1]
    assert reorder([0, 1, 2], 0, 9) == [1, 2, 0]


def test_layout():
    layout = GridLayout.of(3)
    layout.visible[1] = False
    layout.move(2, 0)
    assert layout.displayed() == [2, 0]
    layout.reset()
    assert layout.displayed() == [0, 1, 2]


def test_spans():
    for span in (RowSpan(2, 5), RowSpan(5, 2)):
        assert (span.lo, span.hi, len(span)) == (2, 5, 4)
        assert 2 in span and 5 in span and 1 not in span and 6 not in span
    assert len(RowSpan.single(7)) == 1 and 7 in RowSpan.single(7)


def test_cursor():
    assert move(None, "down", 5) == RowSpan.single(0)
    assert move(RowSpan.single(4), "down", 5) == RowSpan.single(4)
    assert move(RowSpan.single(0), "up", 5) == RowSpan.single(0)
    assert move(RowSpan.single(3), "page_down", 100) == RowSpan.single(23)
    assert move(RowSpan.single(3), "page_up", 100) == RowSpan.single(0)
    assert move(RowSpan.single(3), "end", 100, extend=True) == RowSpan(3, 99)
    assert move(RowSpan.single(3), "home", 100) == RowSpan.single(0)
    assert move(None, "down", 0) is None


def test_find_start():
    assert [find_start(None, f, 9) for f in (True, False)] == [0, 8]
    assert [find_start(RowSpan.single(3), f, 9) for f in (True, False)] == [4, 2]
    assert find_start(RowSpan.single(0), False, 9) is None
    assert find_start(None, True, 0) is None


def test_sort_cycle():
    first = next_sort(None, 2)
    assert first == SortKey(2)
    second = next_sort(first, 2)
    assert second == SortKey(2, Direction.DESCENDING)
    assert next_sort(second, 2) is None
    assert next_sort(second, 1) == SortKey(1)


def test_controls(spark):
    c = ViewControls(search="x", invert=True)
    assert c.desired() == ViewSpec()
    c.filter_mode = True
    assert c.desired() == ViewSpec(FilterSpec("x", invert=True))
    assert c.highlight() == FilterSpec("x")
    assert ViewControls(search="(", regex=True).highlight(spark) is None
    assert ViewControls().highlight() is None
    c.case_sensitive = True
    c.click_header(1)
    c.reset()
    assert c == ViewControls(case_sensitive=True)


def test_saved_view_round_trip(tmp_path):
    layout, controls = GridLayout.of(3), ViewControls(search="q", regex=True, filter_mode=True, sort=SortKey(1, Direction.DESCENDING), case_sensitive=True)
    layout.move(2, 0)
    layout.visible[1] = False
    store = Store(tmp_path)
    store.save_view("/a/b.csv", SavedView.snapshot(layout, controls, ";"))
    saved = store.load_view("/a/b.csv")
    again, fresh = GridLayout.of(3), ViewControls()
    assert saved.apply(again, fresh) == []
    assert again == layout and fresh.desired() == controls.desired()
    assert saved.dialect(Dialect(",")) == Dialect(";")
    assert store.load_view("/other") is None
    other = ViewControls()
    assert saved.apply(GridLayout.of(1), other) == ["column order", "column visibility", "sort"]
    assert other.sort is None
    assert store.size() > 0
    store.clear()
    assert store.load_view("/a/b.csv") is None


def test_old_saved_views_load():
    old = SavedView.loads('{"order": [0], "visible": [true], "sort": [0, true], "filter": null, "unknown": 1}')
    assert old.case_sensitive is False and old.delimiter is None and old.sort == (0, True)


def test_recent(tmp_path):
    store = Store(tmp_path)
    for i in range(12):
        store.add_recent(f"/f{i}")
    assert store.add_recent("/f5")[:2] == ["/f5", "/f11"]
    assert len(store.recent()) == 10
    store.clear_recent()
    assert store.recent() == []


def test_filter_without_query_is_refused_by_column(spark):
    from rowlens.operators.view import TableView
    from rowlens.sources.readers import from_bytes

    with pytest.raises(ValueError):
        TableView(from_bytes(spark, b"a\n1\n")).sorted(SortKey(3))


def test_a_layout_is_kept_when_the_columns_are_as_many():
    layout = GridLayout([2, 0, 1], [True, False, True])
    assert layout.reopened(3) == layout and layout.reopened(3) is not layout
    assert layout.reopened(4) == GridLayout.of(4)
