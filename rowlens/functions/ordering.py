"""The sort order of cells as a key of Catalyst expressions.

Cells that are numbers compare as numbers, exactly where doubles would not
tell integers apart; others by their code points. Comparing pairs that way is
no total order when a column mixes both, so the key puts empty cells first,
then numbers, then text: each part of the key decides only among equals of the
parts before it. NaN comes after all numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.model import RID, Direction

#: A number in the cell, without the space around it.
NUMERIC = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Doubles above this don't tell all integers apart.
_EXACT_FROM = float(1 << 53)


def is_numeric(cell: Column) -> Column:
    return F.btrim(cell, F.lit(SPACES)).rlike(NUMERIC)


def sort_key(cell: Column) -> list[Column]:
    """Parts of a cell's key, most significant first."""
    t = F.btrim(cell, F.lit(SPACES))
    numeric = t.rlike(NUMERIC)
    kind = F.when(cell == "", 0).when(numeric, 1).otherwise(2)
    plain = F.regexp_replace(F.lower(t), r"^[+-](?=nan)|^\+", "")
    num = F.when(numeric, plain.try_cast("double"))
    exact = F.when(numeric & (F.abs(num) >= _EXACT_FROM), F.coalesce(plain.try_cast("decimal(38,0)"), F.lit(0))).otherwise(F.lit(0).cast("decimal(38,0)"))
    return [kind, num, exact, F.when(numeric, "").otherwise(cell)]


def _by_value(kind: T.DataType) -> bool:
    """Types whose values sort as their rendered text does by the key above."""
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DoubleType))


def order_by(column: Column, cell: Column, kind: T.DataType, direction: Direction) -> list[Column]:
    """Sort columns for a view: the key in the direction, then source order, whatever the direction.

    column is the stored value and cell its text; a null is an empty cell.
    """
    down = direction is Direction.DESCENDING
    if _by_value(kind):
        keys: Sequence[Column] = [column.desc_nulls_last() if down else column.asc_nulls_first()]
    else:
        keys = [k.desc() if down else k.asc() for k in sort_key(cell)]
    return [*keys, F.col(RID).asc()]
