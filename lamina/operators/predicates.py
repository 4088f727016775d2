"""Predicates on columns, and the sets of rows they stand for."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.rows import ROWID, positions

if TYPE_CHECKING:
    from lamina.sources.table import Table

#: Values up to which a match is an IN expression; longer lists are an IN subquery.
MATCH_LIST = 10_000


class RowSet:
    """A set of a table's rows: a boolean expression, or a frame of positions.

    Expressions stay expressions under ``&``, ``|`` and ``~``, so that a read with
    them is one scan with pushed filters. Sets of given positions are frames; mixed
    operands meet by position.
    """

    def __init__(self, table: Table, expr: Column | None = None, ids: DataFrame | None = None, column: str | None = None):
        self.table, self.version, self.expr, self._ids, self.column = table, table.version, expr, ids, column

    @classmethod
    def from_rows(cls, table: Table, rows: Iterable[int]) -> RowSet:
        """The set of the given positions, each once."""
        wanted = sorted(set(positions(rows, table.nrows)))
        return cls(table, ids=table.spark.createDataFrame([(i,) for i in wanted], f"{ROWID} long"))

    def materialized(self) -> RowSet:
        """The same set as a frame of positions."""
        return RowSet(self.table, ids=self.df())

    def _other(self, other: object) -> RowSet:
        if not isinstance(other, RowSet):
            raise ValueError("row sets combine with row sets only")
        if other.table.path != self.table.path or other.version != self.version:
            raise ValueError("row sets of different tables or versions do not combine")
        return other

    def __and__(self, other: RowSet) -> RowSet:
        other = self._other(other)
        if self.expr is not None and other.expr is not None:
            return RowSet(self.table, self.expr & other.expr)
        return RowSet(self.table, ids=self.df().join(other.df(), ROWID, "left_semi"))

    def __or__(self, other: RowSet) -> RowSet:
        other = self._other(other)
        if self.expr is not None and other.expr is not None:
            return RowSet(self.table, self.expr | other.expr)
        return RowSet(self.table, ids=self.df().union(other.df()).distinct())

    def __invert__(self) -> RowSet:
        if self.expr is not None:
            return RowSet(self.table, ~self.expr)
        return RowSet(self.table, ids=self.table.frame().select(ROWID).join(self.df(), ROWID, "left_anti"))

    def restrict(self, df: DataFrame) -> DataFrame:
        """The rows of the table's ``df`` that are in the set."""
        return df.filter(self.expr) if self.expr is not None else df.join(self._ids, ROWID, "left_semi")

    def df(self) -> DataFrame:
        """The positions, one column, in no order."""
        return self._ids if self._ids is not None else self.table.frame().filter(self.expr).select(ROWID)

    def sorted(self) -> DataFrame:
        return self.df().orderBy(ROWID)

    def by_value(self) -> DataFrame:
        """Positions ordered by the predicate's column, ties by position; from the column's index where it is fresh."""
        if self.column is None or self.expr is None:
            raise ValueError("only a single predicate has an order by value")
        index = self.table.index_frame(self.column) if self.table.index_is_fresh(self.column) else self.table.frame().select(self.column, ROWID)
        return index.filter(self.expr).orderBy(self.column, ROWID).select(ROWID)

    def ids(self) -> list[int]:
        """Positions on the driver, ascending."""
        return [r[0] for r in self.sorted().collect()]

    array = ids

    def count(self) -> int:
        return self.df().count()

    size = property(count)

    def minmax(self) -> tuple[int | None, int | None]:
        return tuple(self.df().agg(F.min(ROWID), F.max(ROWID)).first())

    def __repr__(self) -> str:
        return f"RowSet({self.table.path}, version {self.version}, {'positions' if self.expr is None else self.expr})"


class Predicates:
    """Comparison operators of a column; ``self.table`` and ``self.name`` come from the subclass."""

    table: Table
    name: str
    __hash__ = object.__hash__

    def _set(self, expr: Column) -> RowSet:
        if self.table.require_index and not self.table.has_index(self.name):
            raise ValueError(f"column {self.name!r} has no index")
        return RowSet(self.table, expr, column=self.name)

    def __gt__(self, value: object) -> RowSet:
        return self._set(F.col(self.name) > value)

    def __ge__(self, value: object) -> RowSet:
        return self._set(F.col(self.name) >= value)

    def __lt__(self, value: object) -> RowSet:
        return self._set(F.col(self.name) < value)

    def __le__(self, value: object) -> RowSet:
        return self._set(F.col(self.name) <= value)

    def __eq__(self, value: object) -> RowSet:  # type: ignore[override]
        return self._set(F.col(self.name) == value)

    def __ne__(self, value: object) -> RowSet:  # type: ignore[override]
        return self._set(F.col(self.name) != value)

    def between(self, low: object, high: object, interval: str = "[]") -> RowSet:
        """Values from ``low`` to ``high``; brackets include an end, parentheses don't."""
        if len(interval) != 2 or interval[0] not in "[(" or interval[1] not in "])":
            raise ValueError(f"bad interval {interval!r}")
        c = F.col(self.name)
        return self._set((c >= low if interval[0] == "[" else c > low) & (c <= high if interval[1] == "]" else c < high))

    def match(self, values: object) -> RowSet:
        """Values that equal any of ``values``."""
        many = list(values) if isinstance(values, Iterable) and not isinstance(values, (str, bytes)) else [values]
        wanted = list(dict.fromkeys(v.item() if hasattr(v, "item") else v for v in many))
        if len(wanted) <= MATCH_LIST:
            return self._set(F.col(self.name).isin(wanted))
        self._set(F.lit(True))
        schema = self.table.frame().select(self.name).schema
        frame = self.table.spark.createDataFrame([(v,) for v in wanted], schema)
        return self._set(F.col(self.name).isin(frame))
