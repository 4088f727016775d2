"""Selection of rows by position."""

from __future__ import annotations

import numbers
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWID = "_rowid"
#: Positions up to which a list becomes an IN filter; longer ones are joined.
IN_LIST = 1000


def is_position(rows: object) -> bool:
    return isinstance(rows, numbers.Integral) and not isinstance(rows, bool)


def slice_bounds(rows: slice, nrows: int, strict_stop: bool = False) -> tuple[int, int, int]:
    """Start, stop and step of a slice: half open, negatives count from the end.

    A start before the first row is an IndexError; a stop past the end is cut, or an
    IndexError for writes (``strict_stop``); an empty range is start = stop.
    """
    step = 1 if rows.step is None else int(rows.step)
    if step < 1:
        raise ValueError("a slice's step must be positive")
    start = 0 if rows.start is None else int(rows.start)
    stop = nrows if rows.stop is None else int(rows.stop)
    if start < -nrows:
        raise IndexError(f"slice starts at {start}, the table has {nrows} rows")
    start, stop = start + nrows * (start < 0), stop + nrows * (stop < 0)
    if stop > nrows:
        if strict_stop:
            raise IndexError(f"slice ends at {stop}, the table has {nrows} rows")
        stop = nrows
    return start, max(start, stop), step


def positions(rows: Iterable, nrows: int) -> list[int]:
    """Positions of a list or array, in its order; negatives count from the end."""
    out = []
    for row in rows:
        if isinstance(row, bool) or type(row).__name__ in ("bool_", "bool"):
            raise ValueError("rows are positions; use a predicate instead of a mask")
        at = int(row)
        if not -nrows <= at < nrows:
            raise IndexError(f"row {at} is out of bounds, the table has {nrows} rows")
        out.append(at + nrows * (at < 0))
    return out


def in_slice(bounds: tuple[int, int, int]) -> Column:
    start, stop, step = bounds
    inside = (F.col(ROWID) >= start) & (F.col(ROWID) < stop)
    return inside if step == 1 else inside & ((F.col(ROWID) - start) % step == 0)


def take(df: DataFrame, wanted: list[int]) -> DataFrame:
    """The rows at ``wanted``, in that order, repeats repeated.

    A range filter comes first, so that a table clustered by position reads few row
    groups. Ascending lists without repeats are a filter; others carry the place in the list through a
    join with the list, which comes from the driver and so is small.
    """
    if not wanted:
        return df.limit(0)
    near = df.filter(F.col(ROWID).between(min(wanted), max(wanted)))
    if len(wanted) <= IN_LIST and all(a < b for a, b in zip(wanted, wanted[1:], strict=False)):
        return near.filter(F.col(ROWID).isin(wanted)).orderBy(ROWID)
    places = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"_pos long, {ROWID} long")
    return near.join(F.broadcast(places), ROWID).orderBy("_pos").drop("_pos")
