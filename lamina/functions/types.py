"""Short type codes and the Spark types they stand for."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The codes a table's columns may have.
_PLAIN: dict[str, T.DataType] = {
    "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(),
    "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0),
    "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType(), "b1": T.BooleanType(),
}
_OTHER: dict[str, T.DataType] = {"U": T.StringType(), "S": T.BinaryType(), "M8": T.TimestampNTZType(), "m8": T.DayTimeIntervalType(), "D": T.DateType()}
_BYTES = {"i1": 1, "i2": 2, "i4": 4, "i8": 8, "u1": 1, "u2": 2, "u4": 4, "u8": 8, "f2": 2, "f4": 4, "f8": 8, "b1": 1, "M8": 8, "m8": 8, "D": 4}


def parse(code: str) -> tuple[str, int | None]:
    """The code's kind and, for text and bytes, its width; byte order marks and units are dropped."""
    bare = re.sub(r"^[<>=|]", "", code)
    if found := re.fullmatch(r"([US])([0-9]*)", bare):
        return found[1], int(found[2]) if found[2] else None
    bare = re.sub(r"\[.*\]$", "", bare)
    bare = {"?": "b1"}.get(bare, bare)
    if bare in _PLAIN or bare in _OTHER:
        return bare, None
    raise ValueError(f"unknown type code {code!r}")


def spark_type(code: str) -> T.DataType:
    kind, _ = parse(code)
    return _PLAIN.get(kind) or _OTHER[kind]


def code_of(kind: T.DataType) -> str:
    """The code of a Spark type; types without one (arrays, structs) get their own string."""
    for code in ("i1", "i2", "i4", "i8", "f4", "f8", "b1"):
        if kind == _PLAIN[code]:
            return code
    for code, own in _OTHER.items():
        if type(kind) is type(own):
            return code
    return kind.simpleString()


def width_bytes(code: str) -> int:
    """Bytes of a value; of text, four for each character."""
    try:
        kind, width = parse(code)
    except ValueError:
        return 8
    return {"U": 4, "S": 1}[kind] * (width or 8) if kind in "US" else _BYTES[kind]


def zero(code: str) -> object:
    """What missing values of a type become: the zero bit pattern."""
    try:
        kind, _ = parse(code)
    except ValueError:
        return None
    if kind == "U":
        return ""
    if kind == "S":
        return b""
    if kind[0] == "f":
        return 0.0
    if kind == "b1":
        return False
    return 0 if kind in _PLAIN else None
