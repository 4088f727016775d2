"""Specifications of columns and tables, and coercion of values to them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import sizes, types

#: What compressed columns use if nothing else is said.
COMPRESSION = {"cname": "zstd", "clevel": 5, "shuffle": "bitshuffle"}
CHUNKSIZE = "1m"


@dataclass(frozen=True)
class ColumnSpec:
    """Name, type code, and how a column is compressed and filled.

    Compression and chunk size are kept for all columns; Parquet files have one
    codec, level and size of row groups for the table (see TableSpec.write_options).
    """

    name: str
    dtype: str
    compression: bool | dict | None = None
    chunksize: str | int | None = None
    fill_value: object = None

    def __post_init__(self) -> None:
        if "/" in self.name or self.name.startswith("_") or not self.name:
            raise ValueError(f"bad column name {self.name!r}")
        if self.compression is True:
            object.__setattr__(self, "compression", dict(COMPRESSION))
        elif self.compression:
            object.__setattr__(self, "compression", COMPRESSION | dict(self.compression))
        else:
            object.__setattr__(self, "compression", None)
        if self.compression and self.chunksize is None:
            object.__setattr__(self, "chunksize", CHUNKSIZE)

    @property
    def spark_type(self) -> T.DataType:
        try:
            return types.spark_type(self.dtype)
        except ValueError:
            return T._parse_datatype_string(self.dtype)

    @property
    def width(self) -> int | None:
        try:
            return types.parse(self.dtype)[1]
        except ValueError:
            return None

    @property
    def fill(self) -> object:
        return types.zero(self.dtype) if self.fill_value is None else self.fill_value

    def fill_column(self) -> Column:
        value = self.fill
        if isinstance(value, str) and isinstance(self.spark_type, T.BinaryType):
            value = value.encode()
        return self.cut(F.lit(value).cast(self.spark_type))

    def cut(self, column: Column) -> Column:
        """Text and bytes keep as many characters as the column is wide."""
        return F.substring(column, 1, self.width) if self.width else column

    def coerce(self, column: Column) -> Column:
        """A value as this column holds it: cast, cut to the width, missing values filled. Bad casts fail when run."""
        cast = self.cut(column.cast(self.spark_type))
        return cast if self.fill is None else F.coalesce(cast, self.fill_column())

    def to_json(self) -> dict:
        out = asdict(self)
        if isinstance(out["fill_value"], bytes):
            out["fill_value"] = out["fill_value"].decode()
        return out


class TableSpec(Mapping):
    """Column specifications by name, in order."""

    def __init__(self, columns: Iterable[ColumnSpec] = ()):
        self._columns: dict[str, ColumnSpec] = {}
        for column in columns:
            self.add_column(column)

    def add_column(self, column: ColumnSpec) -> None:
        if column.name in self._columns:
            raise RuntimeError(f"column {column.name!r} already exists")
        self._columns[column.name] = column

    def __getitem__(self, name: str) -> ColumnSpec:
        return self._columns[name]

    def __iter__(self):
        return iter(self._columns)

    def __len__(self) -> int:
        return len(self._columns)

    def __repr__(self) -> str:
        return "TableSpec(\n" + "".join(f"  {c}\n" for c in self._columns.values()) + ")"

    @classmethod
    def from_dict(cls, columns: Mapping[str, Mapping]) -> TableSpec:
        return cls(ColumnSpec(name, **kwargs) for name, kwargs in columns.items())

    from_columns = classmethod(lambda cls, columns: cls(columns))

    @classmethod
    def from_dataframe(cls, df: DataFrame, compression: object = None, chunksize: object = None) -> TableSpec:
        """Specifications inferred from a frame.

        ``compression``: None or False for none, True for all, a list of the names
        compressed, or a dict by name. ``chunksize``: one for all, or a dict by name.
        """
        if isinstance(chunksize, (list, set, tuple)):
            raise ValueError("chunksize is one size or a dict by name")
        out = cls()
        for field in df.schema.fields:
            if field.name.startswith("_"):
                continue
            if isinstance(compression, Mapping):
                own = compression.get(field.name)
            elif isinstance(compression, (list, set, tuple)):
                own = field.name in compression
            else:
                own = compression
            chunk = chunksize.get(field.name, CHUNKSIZE) if isinstance(chunksize, Mapping) else chunksize
            out.add_column(ColumnSpec(field.name, types.code_of(field.dataType), own, chunk if own else None))
        return out

    def write_options(self) -> dict[str, str]:
        """How Parquet files of the table are written: the strongest codec and level that a column asks for (zstd if none does), row groups as large as the largest chunk for all columns, a megabyte at least."""
        asked = [c for c in self._columns.values() if c.compression]
        # Codecs by their names in specifications, weakest first
        codecs = {"blosclz": "snappy", "snappy": "snappy", "lz4": "lz4_raw", "lz4hc": "lz4_raw", "zlib": "gzip", "zstd": "zstd"}
        names = [str(c.compression["cname"]) for c in asked]
        if wrong := [n for n in names if n not in codecs]:
            raise ValueError(f"unknown codecs {wrong}, there are {list(codecs)}")
        codec = codecs[max(names, key=list(codecs).index)] if names else "zstd"
        out = {"compression": codec}
        levels = [int(c.compression["clevel"]) for c in asked if codecs[str(c.compression["cname"])] == codec]
        if codec == "zstd" and levels:
            out["parquet.compression.codec.zstd.level"] = str(min(22, max(1, *levels, 1)))
        sized = [c for c in asked if c.chunksize is not None]
        if sized:
            row = sum(types.width_bytes(c.dtype) for c in self._columns.values())
            rows = max(sizes.chunk_rows(c.chunksize, types.width_bytes(c.dtype)) for c in sized)
            out["parquet.block.size"] = str(max(1 << 20, min(1 << 30, rows * row)))
        return out

    def to_struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True, {k: v for k, v in c.to_json().items() if k not in ("name",) and v is not None}) for c in self._columns.values()])
