"""A Spark data source for binary tables in FITS files.

Registered as format "fits"; options: path, ext (number of the extension, 1), rows
(rows a partition, 100000). Files are read on the executors, from a mounted path or
any store that Arrow's file systems open by its URI. Numbers, logicals, fixed-width
text and arrays of fixed length (TDIM is left out: they are flat) are supported,
with TSCAL, TZERO and TNULL applied; bits, complex numbers and arrays on the heap are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Headers and data are padded to blocks of this many bytes.
BLOCK = 2880
# Format letters of table columns, as (NumPy type, Spark type).
FORMATS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


#: Of integers, the offset that stands for the other kind of sign, and what then holds them.
SIGNS = {"B": (-128, "short"), "I": (1 << 15, "int"), "J": (1 << 31, "bigint"), "K": (1 << 63, "decimal(20,0)")}


@dataclass
class Field:
    """A column: its place in a row as NumPy sees it, its Spark type, and what its numbers mean."""

    name: str
    kind: str
    spark: str
    repeat: int | None  # of an array
    scale: float
    zero: float
    null: int | None


@dataclass
class Layout:
    fields: list[Field]
    rows: int
    width: int
    start: int


def _open(path: str):
    """A file for reading, by path or URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _cards(f) -> dict[str, object]:
    out: dict[str, object] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise EOFError("no such extension")
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii")
            key = card[:8].strip()
            if key == "END":
                return out
            if card[8:10] == "= ":
                text = card[10:]
                if found := re.match(r"\s*'((?:[^']|'')*)'", text):
                    out[key] = found[1].replace("''", "'").rstrip()
                else:
                    bare = text.split("/")[0].strip()
                    out[key] = {"T": True, "F": False}.get(bare, int(bare) if re.fullmatch(r"[+-]?[0-9]+", bare) else _number(bare))


def _number(text: str) -> object:
    try:
        return float(text.replace("D", "E").replace("d", "e"))
    except ValueError:
        return text


def _padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def layout(path: str, ext: int) -> Layout:
    """The columns, size and place of a table extension."""
    with _open(path) as f:
        for k in range(ext + 1):
            cards = _cards(f)
            start = f.tell()
            size = abs(int(cards["BITPIX"])) // 8 if cards["NAXIS"] else 0
            for a in range(1, int(cards["NAXIS"]) + 1):
                size *= int(cards[f"NAXIS{a}"])
            size += int(cards.get("PCOUNT", 0)) if k else 0
            if k < ext:
                f.seek(start + _padded(size))
    if cards.get("XTENSION") != "BINTABLE":
        raise ValueError(f"extension {ext} of {path} is no binary table")
    fields = []
    for c in range(1, int(cards["TFIELDS"]) + 1):
        repeat, letter = re.match(r"\s*([0-9]*)([A-Z])", str(cards[f"TFORM{c}"])).groups()
        if letter not in FORMATS:
            raise ValueError(f"column {c} has the format {cards[f'TFORM{c}']}, which is not supported")
        n = int(repeat or 1)
        kind, spark = FORMATS[letter]
        scale, zero, null = cards.get(f"TSCAL{c}", 1), cards.get(f"TZERO{c}", 0), cards.get(f"TNULL{c}")
        if letter in SIGNS and (scale, zero) == (1, SIGNS[letter][0]):
            spark = SIGNS[letter][1]
        elif letter not in "LA" and (scale, zero) != (1, 0):
            spark = "double"
        many = None if letter == "A" or n == 1 else n
        kind = f"S{n}" if letter == "A" else kind
        fields.append(Field(str(cards.get(f"TTYPE{c}", f"col{c}")), kind, spark, many, scale, zero, null if letter in SIGNS else None))
    return Layout(fields, int(cards["NAXIS2"]), int(cards["NAXIS1"]), start)


def values(field: Field, own):
    """The values of a column's flat numbers, as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    if field.spark == "string":
        return pa.array([x.decode("ascii", "replace").rstrip("\0 ") for x in own.tolist()], pa.string())
    if field.spark == "boolean":
        return pa.array(own == b"T", mask=(own != b"T") & (own != b"F"))
    missing = own == field.null if field.null is not None else None
    if field.spark == "decimal(20,0)":
        # the upper bit turned over is the offset added
        plain = (own.astype("i8").view("u8") ^ np.uint64(1 << 63)).tolist()
        return pa.array([None if missing is not None and m else Decimal(x) for x, m in zip(plain, missing if missing is not None else plain, strict=True)], pa.decimal128(20, 0))
    if field.spark == "double" and own.dtype.kind != "f" or (field.scale, field.zero) != (1, 0) and field.spark == "double":
        return pa.array(own.astype("f8") * field.scale + field.zero, mask=missing)
    whole = {"short": "i2", "int": "i4", "bigint": "i8"}.get(field.spark)
    return pa.array(own.astype("i8").__add__(int(field.zero)).astype(whole) if whole else own.astype(own.dtype.newbyteorder("=")), mask=missing)


def table_bytes(columns: list, rows: int) -> bytes:
    """A FITS file of one table from (name, format, array of a row each, more cards as {key: value})."""
    import numpy as np

    def block(cards: list[str]) -> bytes:
        text = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
        return text.ljust(_padded(len(text)))

    row = np.dtype([(f"f{k}", a.dtype, a.shape[1:]) for k, (_, _, a, _) in enumerate(columns)])
    data = np.zeros(rows, row)
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {row.itemsize}", f"NAXIS2  = {rows}", "PCOUNT  = 0", "GCOUNT  = 1", f"TFIELDS = {len(columns)}"]
    for k, (name, form, own, more) in enumerate(columns):
        data[f"f{k}"] = own
        cards += [f"{key}{k + 1}".ljust(8) + f"= {value}" for key, value in {"TTYPE": f"'{name}'", "TFORM": f"'{form}'", **more}.items()]
    body = data.tobytes()
    return block(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0"]) + block(cards) + body.ljust(_padded(len(body)), b"\0")


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ext, self.step = options["path"], int(options.get("ext", 1)), int(options.get("rows", 100_000))

    def partitions(self) -> list[Rows]:
        n = layout(self.path, self.ext).rows
        return [Rows(a, min(a + self.step, n)) for a in range(0, n, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found = layout(self.path, self.ext)
        row = np.dtype([(f"f{k}", c.kind, () if c.repeat is None else (c.repeat,)) for k, c in enumerate(found.fields)])
        n = partition.last - partition.first
        with _open(self.path) as f:
            f.seek(found.start + partition.first * found.width)
            data = np.frombuffer(f.read(n * found.width), row)
        arrays = []
        for k, field in enumerate(found.fields):
            flat = values(field, data[f"f{k}"].reshape(-1))
            if field.repeat is not None:
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * field.repeat), flat)
            arrays.append(flat)
        yield pa.RecordBatch.from_arrays(arrays, [c.name for c in found.fields])


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        found = layout(self.options["path"], int(self.options.get("ext", 1)))
        return ", ".join(f"`{c.name}` {c.spark if c.repeat is None else f'array<{c.spark}>'}" for c in found.fields)

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options)
