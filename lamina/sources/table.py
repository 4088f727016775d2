"""Versioned tables with row positions, their columns and the namespace of sub-tables.

A table is a folder: ``manifest/N.json`` for each version N, data files under
``data/``, index projections under ``index/``, documents under ``meta/`` and
sub-tables ``NAME.table/``. A manifest lists the files with their ranges of row
positions. A change writes new files for the ranges it touches and then the next
manifest; a failure before that leaves the last version as it is, and two
writers cannot both write the same next one. ``vacuum`` removes what no version needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import sizes, types
from lamina.functions.spec import ColumnSpec, TableSpec
from lamina.operators.predicates import Predicates, RowSet
from lamina.operators.rows import ROWID, in_slice, is_position, positions, slice_bounds, take
from lamina.sources.files import Files
from lamina.sources.meta import MetaSet

SUFFIX = ".table"
#: A file's name beside its rows.
FILE = "_file"
#: Bytes of values in a data file, and how many files one change writes before they get larger.
FILE_BYTES, MOST_FILES = 256 << 20, 50_000


def rows_per_file(n: int, width: int) -> int:
    """How many of ``n`` rows of ``width`` bytes go into a file."""
    return max(1, FILE_BYTES // max(1, width), -(-n // MOST_FILES))


def runs_of(files: list[dict]) -> list[tuple[int, int, list[dict]]]:
    """(first position, rows, files) of each stretch of files without a gap."""
    out: list[tuple[int, int, list[dict]]] = []
    for f in sorted(files, key=lambda f: f["low"]):
        if out and out[-1][0] + out[-1][1] == f["low"]:
            low, n, some = out[-1]
            some.append(f)
            out[-1] = (low, n + f["n"], some)
        else:
            out.append((f["low"], f["n"], [f]))
    return out


def number_rows(df: DataFrame, path: str, first: int = 0) -> DataFrame:
    """Write ``df`` to ``path`` and read it back with positions from ``first`` on, in partition order.

    The written rows carry their task's number and their place in it; counts by task,
    one row each, give every task its first position. No rows meet in one task.
    """
    spark = df.sparkSession
    placed = df.withColumn("_mid", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(placed.schema).parquet(path).withColumn("_task", F.shiftright("_mid", 33))
    counts = staged.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + first).alias("_start"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return staged.join(F.broadcast(starts), "_task").withColumn(ROWID, F.col("_start") + local).drop("_task", "_mid", "_start")


class ColumnRef(Predicates):
    """A column of a table: reads, predicates, updates and its index."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name

    spec = property(lambda self: self.table.spec[self.name])
    dtype = property(lambda self: self.spec.dtype)
    nrows = property(lambda self: self.table.nrows)
    size = nrows
    has_index = property(lambda self: self.table.has_index(self.name))
    mode = property(lambda self: self.table.mode)
    cache_mem = property(lambda self: self.table.cache_mem)
    cache_mem_gb = property(lambda self: sizes.cache_gb(self.table.cache_mem))
    data_size_bytes = property(lambda self: self.nrows * types.width_bytes(self.dtype))
    data_size_gb = property(lambda self: self.data_size_bytes / 1024**3)
    index_size_bytes = property(lambda self: self.table.index_size_bytes(self.name))
    index_size_gb = property(lambda self: self.index_size_bytes / 1024**3)
    index_dtype = property(lambda self: [("value", self.dtype), ("row", "i8")])
    filenames = property(lambda self: self.table.filenames)
    index_filenames = property(lambda self: self.table.index_filenames(self.name))

    def read(self, rows: object = None) -> DataFrame:
        return self.table.read(self.name, rows)

    def __getitem__(self, rows: object) -> object:
        """The column at rows; one position gives the value."""
        if is_position(rows):
            return self.read(rows).first()[0]
        return self.read(rows)

    def __setitem__(self, rows: object, values: object) -> None:
        self.table.set(self.name, rows, values)

    def read_into(self, buffer: object, rows: object = None) -> None:
        self.table.read_into(self.name, buffer, rows)

    def read_slice_into(self, rows: slice, buffer: object) -> None:
        self.table.read_into(self.name, buffer, rows)

    def read_rows_into(self, rows: Sequence[int], buffer: object) -> None:
        self.table.read_into(self.name, buffer, list(rows))

    def read_row_into(self, row: int, buffer: object) -> None:
        self.table.read_into(self.name, buffer, [row])

    def create_index(self, overwrite: bool = False) -> None:
        self.table.create_index(self.name, overwrite)

    def update_index(self) -> None:
        self.table.update_index(self.name)

    def delete_index(self) -> None:
        self.table.delete_index(self.name)

    def resize(self, nrows: int) -> None:
        """All columns of a table have one length, so this resizes the table."""
        self.table.resize(nrows)

    def vacuum(self) -> None:
        self.table.vacuum()

    def reload(self) -> None:
        self.table.reload([self.name])

    def updating(self, vacuum: bool = False):
        return self.table.updating(vacuum)

    def __enter__(self) -> ColumnRef:
        self.table.__enter__()
        return self

    def __exit__(self, *args: object) -> None:
        self.table.__exit__(*args)

    def __repr__(self) -> str:
        return f"Column({self.name!r}, {self.dtype!r}, rows: {self.nrows}, index: {self.has_index})"


class Projection:
    """Columns chosen, rows not yet."""

    def __init__(self, table: Table, columns: list[str]):
        self.table, self.columns = table, columns

    def __getitem__(self, rows: object) -> DataFrame:
        return self.table.read(self.columns, rows)

    def __repr__(self) -> str:
        return f"Projection({self.table.path}, {self.columns})"


class Table(Mapping):
    """A table and the folder of its sub-tables; a mapping of columns and sub-tables by name."""

    type = "table"

    def __init__(self, spark: SparkSession, path: str, mode: str = "r", cache_mem: str | float = "1g", verbose: bool = False, require_index: bool = False):
        if mode not in ("r", "r+"):
            raise RuntimeError(f"bad mode {mode!r}, use 'r' or 'r+'")
        sizes.cache_gb(cache_mem)
        self.spark, self.files, self.mode, self.cache_mem, self.verbose, self.require_index = spark, Files(spark, path), mode, cache_mem, verbose, require_index
        self.path = self.files.root
        self._depth, self._vacuum_on_exit = 0, False
        self._children: dict[str, Table] = {}
        self._load()

    # ---- versions

    def _load(self) -> None:
        versions = [int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json")]
        if not versions:
            raise RuntimeError(f"no table at {self.path}")
        self._state = self.files.read_json(f"manifest/{max(versions):010d}.json")

    @staticmethod
    def make(spark: SparkSession, path: str, yes: bool = False) -> None:
        """An empty table at a path; one that is there is an error, unless ``yes``, which removes it."""
        files = Files(spark, path)
        if files.exists():
            if not yes:
                raise RuntimeError(f"{files.root} exists; say yes=True to replace it")
            files.delete()
        files.write_json(f"manifest/{0:010d}.json", {"version": 0, "nrows": 0, "columns": [], "files": [], "indexes": {}, "next": 0})

    def _commit(self, **changes: object) -> None:
        old = self._state
        new = {**old, **changes, "version": old["version"] + 1}
        if {"nrows", "files"} & set(changes):
            touched = changes.get("touched")
            new["indexes"] = {c: {**x, "fresh": x["fresh"] and touched is not None and c not in touched} for c, x in new["indexes"].items()}
        new.pop("touched", None)
        self.files.write_json(f"manifest/{new['version']:010d}.json", new, replace=False)
        self._state = new
        if not self._depth:
            self._refresh_indexes()

    version = property(lambda self: self._state["version"])
    nrows = property(lambda self: self._state["nrows"])
    size = nrows
    dir = property(lambda self: self.path)
    is_updating = property(lambda self: self._depth > 0)
    meta = property(lambda self: MetaSet(self))
    cache_mem_gb = property(lambda self: sizes.cache_gb(self.cache_mem))
    filenames = property(lambda self: [self.files.at(f["path"]) for f in self._state["files"]])

    @property
    def spec(self) -> TableSpec:
        return TableSpec(ColumnSpec(**{k: v for k, v in c.items() if k not in ("physical", "since")}) for c in self._state["columns"])

    def check_writable(self, what: str) -> None:
        if self.mode != "r+":
            raise OSError(f"cannot {what} in read only mode")

    # ---- names

    @property
    def column_names(self) -> list[str]:
        return [c["name"] for c in self._state["columns"]]

    @property
    def sub_table_names(self) -> list[str]:
        return [n[: -len(SUFFIX)] + "/" for n in self.files.names() if n.endswith(SUFFIX)]

    meta_names = property(lambda self: list(self.meta))
    names = property(lambda self: [*self.column_names, *self.sub_table_names, *self.meta_names])

    def __iter__(self) -> Iterator[str]:
        return iter([*self.column_names, *self.sub_table_names])

    def __len__(self) -> int:
        return len(self.column_names) + len(self.sub_table_names)

    def get(self, name: str, default: object = None) -> object:
        try:
            return self[name]
        except IndexError:
            return default

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self.get(name) is not None

    def _child(self, name: str) -> Table:
        if name not in self._children:
            self._children[name] = Table(self.spark, self.files.at(name + SUFFIX), self.mode, self.cache_mem, self.verbose, self.require_index)
        return self._children[name]

    def _resolve(self, path: str) -> ColumnRef | Table:
        here: Table = self
        parts = [p for p in path.split("/") if p not in ("", ".")]
        for k, part in enumerate(parts):
            if k == len(parts) - 1 and not path.endswith("/") and part in here.column_names:
                return ColumnRef(here, part)
            if part + "/" not in here.sub_table_names:
                raise IndexError(f"no column or table {path!r} in {self.path}")
            here = here._child(part)
        return here

    def __getitem__(self, key: object) -> object:
        """A column or sub-table by path, columns by a list of names, or rows."""
        if isinstance(key, str):
            return self._resolve(key)
        if isinstance(key, (list, tuple)) and key and all(isinstance(k, str) for k in key):
            return Projection(self, self._checked(key))
        return self.read(rows=key)

    def __setitem__(self, name: str, values: object) -> None:
        found = self._resolve(name)
        if isinstance(found, Table):
            raise TypeError("cannot assign to a table")
        found.table.set(found.name, None, values)

    def _checked(self, columns: str | Sequence[str] | None) -> list[str]:
        if columns is None:
            return self.column_names
        wanted = [columns] if isinstance(columns, str) else list(columns)
        if missing := [c for c in wanted if c not in self.column_names]:
            raise ValueError(f"no columns {missing} in {self.path}")
        return wanted

    # ---- reads

    def frame(self, files: list[dict] | None = None, with_file: bool = False) -> DataFrame:
        """All rows with their positions, lazily; columns that files lack hold their fill value. ``with_file`` adds the file's name."""
        files = self._state["files"] if files is None else files
        columns = self._state["columns"]
        spec = self.spec
        schema = T.StructType([T.StructField(ROWID, T.LongType()), *(T.StructField(c["physical"], spec[c["name"]].spark_type) for c in columns)])
        if files:
            raw = self.spark.read.schema(schema).parquet(*[self.files.at(p) for p in _paths(files)])
            name = F.col("_metadata.file_name").alias(FILE)
        else:
            raw, name = self.spark.createDataFrame([], schema), F.lit("").alias(FILE)
        oldest = min((f["version"] for f in files), default=0)
        out = [F.col(ROWID)]
        for c in columns:
            own = F.col(c["physical"])
            if c["since"] > oldest and spec[c["name"]].fill is not None:
                own = F.coalesce(own, spec[c["name"]].fill_column())
            out.append(own.alias(c["name"]))
        return raw.select(*out, *([name] if with_file else []))

    df = property(lambda self: self.frame())

    def select_rows(self, rows: object) -> DataFrame:
        """The rows, with positions: None for all, a slice, a position, a list of positions, a RowSet or a boolean Column."""
        if rows is None:
            return self.frame()
        if isinstance(rows, RowSet):
            if rows.table.path != self.path or rows.version != self.version:
                raise ValueError("the row set is of another table or version")
            return rows.restrict(self.frame())
        if isinstance(rows, Column):
            return self.frame().filter(rows)
        if isinstance(rows, slice):
            return self.frame().filter(in_slice(slice_bounds(rows, self.nrows)))
        return take(self.frame(), positions([rows] if is_position(rows) else rows, self.nrows))

    def read(self, columns: str | Sequence[str] | None = None, rows: object = None, asdict: bool = False) -> object:
        """Columns (None: all) of rows (None: all) as a lazy frame; ``asdict`` collects arrays by name. A table without columns gives None."""
        wanted = self._checked(columns)
        if not wanted:
            return None
        out = self.select_rows(rows).select(*wanted)
        return self.to_arrays(out) if asdict else out

    @staticmethod
    def to_arrays(df: DataFrame) -> dict:
        """The frame's columns as arrays on the driver, by name."""
        table = df.toArrow()
        return {n: table.column(n).to_numpy() for n in table.column_names}

    def read_into(self, column: str, buffer: object, rows: object = None) -> None:
        """Fill a one-dimensional array with a column's values in rows: None for all, a slice, a position, a list of positions or a RowSet. Its length and kind must fit."""
        got = self.to_arrays(self.read(column, rows))[column]
        if getattr(buffer, "ndim", 0) != 1:
            raise ValueError("the buffer must have one dimension")
        if len(buffer) != len(got) or buffer.dtype.kind != got.dtype.kind:
            raise ValueError(f"the buffer has {len(buffer)} of {buffer.dtype}, the rows are {len(got)} of {got.dtype}")
        buffer[:] = got

    def where(self, rows: RowSet | Column) -> DataFrame:
        return self.read(rows=rows)

    def ordered(self) -> DataFrame:
        return self.frame().orderBy(ROWID).drop(ROWID)

    # ---- writes

    def _write(self, rows: DataFrame, runs: list[tuple[int, int, list[dict]]]) -> list[dict]:
        """Write rows (with positions) clustered by position; the files and their ranges.

        ``runs`` says which positions there are (see runs_of), so each row's file
        follows from its position: nothing is sampled, and ``rows`` is worked out once.
        Rows of several runs come with the names of their files, which are as many as the
        manifest lists and tell the run.
        """
        columns = self._state["columns"]
        version = self.version + 1
        name = f"data/v{version:010d}-{uuid.uuid4().hex}"
        total = sum(n for _, n, _ in runs)
        if not total:
            return []
        each = rows_per_file(total, sum(types.width_bytes(c.dtype) for c in self.spec.values()))
        places, parts = [], 0
        for low, n, files in runs:
            places.append((low, parts, files))
            parts += -(-n // each)
        if len(runs) > 1:
            where = [(f["path"].rpartition("/")[2], low, first) for low, first, files in places for f in files]
            rows = rows.join(F.broadcast(self.spark.createDataFrame(where, f"{FILE} string, _low long, _first long")), FILE)
            low, first = F.col("_low"), F.col("_first")
        else:
            low, first = F.lit(places[0][0]), F.lit(0)
        part = (first + F.floor((F.col(ROWID) - low) / each)).cast("int").alias("_part")
        out = rows.select(ROWID, *[F.col(c["name"]).alias(c["physical"]) for c in columns], part)
        try:
            placed = out.repartitionById(parts, F.col("_part")).drop("_part").sortWithinPartitions(ROWID)
            placed.write.options(**self.spec.write_options()).parquet(self.files.at(name))
        except PySparkException as e:
            self.files.delete(name)
            raise _as_value_error(e) from e
        written = self.spark.read.schema(f"{ROWID} long").parquet(self.files.at(name)).select(ROWID, F.col("_metadata.file_name").alias("file"))
        ranges = written.groupBy("file").agg(F.min(ROWID).alias("low"), F.max(ROWID).alias("high"), F.count(F.lit(1)).alias("n")).collect()
        return [{"path": f"{name}/{r['file']}", "low": r["low"], "high": r["high"], "n": r["n"], "of": len(ranges), "version": version} for r in sorted(ranges, key=lambda r: r["low"])]

    def _number(self, df: DataFrame, first: int) -> DataFrame:
        self._staged = f"data/staged-{uuid.uuid4().hex}"
        try:
            return number_rows(df, self.files.at(self._staged), first)
        except PySparkException as e:
            self.files.delete(self._staged)
            raise _as_value_error(e) from e

    def append(self, data: object, verify: bool = True, batch: tuple[str, int] | None = None) -> None:
        """Add rows; positions go on from the last. The names must be the table's, in any order; values are cast to its types, and missing ones become the column's fill value.

        ``batch``, a stream's name and a number, is kept in the same manifest (see last_batch).
        """
        self.check_writable("append")
        df = self.to_frame(data)
        names = [c for c in df.columns if c != ROWID]
        if set(names) != set(self.column_names):
            raise ValueError(f"the data have columns {names}, the table {self.column_names}")
        numbered = self._number(df.select(*[c.coerce(F.col(c.name)).alias(c.name) for c in self.spec.values()]), self.nrows)
        # counted from the footers of what is staged
        count = self.spark.read.schema("_mid long").parquet(self.files.at(self._staged)).count()
        files = self._write(numbered, [(self.nrows, count, [])])
        self.files.delete(self._staged)
        seen = {"streams": {**self._state.get("streams", {}), batch[0]: batch[1]}} if batch else {}
        self._commit(files=[*self._state["files"], *files], nrows=self.nrows + sum(f["n"] for f in files), **seen)
        if verify:
            self._check_ranges()

    def last_batch(self, name: str) -> int:
        """The number of the last batch that a stream appended, -1 if there is none."""
        return self._state.get("streams", {}).get(name, -1)

    def to_frame(self, data: object) -> DataFrame:
        """A frame from a frame, a dict of equal columns, a NumPy structured array, or a pandas or Arrow table."""
        if isinstance(data, DataFrame):
            return data
        import pyarrow as pa

        if isinstance(data, Mapping):
            if len({len(v) for v in data.values()}) > 1:
                raise ValueError("columns differ in length")
            data = pa.table({k: _arrow(v) for k, v in data.items()})
        elif not isinstance(data, pa.Table) and not hasattr(data, "iloc"):
            if getattr(getattr(data, "dtype", None), "names", None) is None:
                raise ValueError("the data have no named columns")
            return self.to_frame({n: data[n] for n in data.dtype.names})
        return self.spark.createDataFrame(data)

    def create_column(self, spec: ColumnSpec) -> None:
        """Add a column that holds its fill value in all rows; only the manifest changes."""
        self.check_writable("create a column")
        self._add(TableSpec([spec]))

    def _add(self, spec: TableSpec) -> None:
        if both := [n for n in spec if n in self.column_names]:
            raise RuntimeError(f"columns {both} already exist")
        n = self._state["next"]
        new = [{**c.to_json(), "physical": f"c{n + k}", "since": self.version + 1} for k, c in enumerate(spec.values())]
        self._commit(columns=[*self._state["columns"], *new], next=n + len(new))

    def _files_of(self, rows: object) -> list[dict]:
        """The files that hold any of the rows."""
        files = self._state["files"]
        if isinstance(rows, slice):
            a, b, _ = slice_bounds(rows, self.nrows, True)
            return [f for f in files if f["low"] < b and f["high"] >= a]
        if isinstance(rows, list):
            import bisect

            ordered = sorted(rows)
            return [f for f in files if (k := bisect.bisect_left(ordered, f["low"])) < len(ordered) and ordered[k] <= f["high"]]
        # a name for each file that holds a hit, whatever lies between the hits
        placed = self.frame(files, with_file=True)
        hit = placed.filter(rows.expr) if rows.expr is not None else placed.select(ROWID, FILE).join(rows.df(), ROWID, "left_semi")
        found = {r[0] for r in hit.select(FILE).distinct().collect()}
        return [f for f in files if f["path"].rpartition("/")[2] in found]

    def set(self, column: str, rows: object, values: object) -> None:
        """Set a column's values in rows: one value for all, or one each.

        Rows are None, a slice, a position, a list of positions or a RowSet. Only
        files whose range of positions meets the rows are written anew. Of a position
        listed twice the last value holds.
        """
        self.check_writable("update")
        spec = self.spec[self._checked(column)[0]]
        rows = slice(None) if rows is None else [rows] if is_position(rows) else rows
        if isinstance(rows, RowSet):
            count = None
        elif isinstance(rows, slice):
            a, b, step = slice_bounds(rows, self.nrows, True)
            count = len(range(a, b, step))
        else:
            rows = positions(rows, self.nrows)
            count = len(rows)
        many = isinstance(values, DataFrame) or (isinstance(values, Sequence) and not isinstance(values, (str, bytes))) or getattr(values, "ndim", 0) == 1
        if many and not isinstance(values, DataFrame):
            values = values.tolist() if hasattr(values, "tolist") else list(values)
            if isinstance(rows, RowSet):
                rows = rows.ids()
                count = len(rows)
            if len(values) == 1 and count != 1:
                many, values = False, values[0]
            elif len(values) != count:
                raise IndexError(f"{len(values)} values for {count} rows")
        files = self._files_of(rows)
        if not files or count == 0:
            return
        old = self.frame(files, with_file=True)
        if many:
            updates = self._updates(rows, values, count, spec)
            new = old.join(updates, ROWID, "left").withColumn(column, F.coalesce("_value", column)).drop("_value")
        else:
            value = spec.coerce(F.lit(values))
            if isinstance(rows, RowSet) and rows.expr is not None:
                hit = rows.expr
            elif isinstance(rows, slice):
                hit = in_slice(slice_bounds(rows, self.nrows))
            else:
                ids = rows.df() if isinstance(rows, RowSet) else self.spark.createDataFrame([(i,) for i in sorted(set(rows))], f"{ROWID} long")
                old = old.join(ids.withColumn("_hit", F.lit(True)), ROWID, "left")
                hit = F.col("_hit")
            new = old.withColumn(column, F.when(hit, value).otherwise(F.col(column))).drop("_hit")
        written = self._write(new, runs_of(files))
        kept = [f for f in self._state["files"] if f not in files]
        if sum(f["n"] for f in written) != sum(f["n"] for f in files):
            raise RuntimeError("an update must not change the number of rows")
        self._commit(files=sorted([*kept, *written], key=lambda f: f["low"]), touched=[column])

    def _updates(self, rows: object, values: object, count: int | None, spec: ColumnSpec) -> DataFrame:
        if isinstance(values, DataFrame):
            staged = f"data/staged-{uuid.uuid4().hex}"
            numbered = number_rows(values.select(spec.coerce(F.col(values.columns[0])).alias("_value")), self.files.at(staged))
            if isinstance(rows, RowSet):
                raise ValueError("give a frame of values for a slice or a list of rows")
            if numbered.count() != count:
                self.files.delete(staged)
                raise IndexError(f"the frame does not have {count} rows")
            if isinstance(rows, slice):
                a, _, step = slice_bounds(rows, self.nrows)
                return numbered.select((F.col(ROWID) * step + a).alias(ROWID), "_value")
            at = self.spark.createDataFrame(list(enumerate(rows)), f"{ROWID} long, _to long")
            return numbered.join(at, ROWID).select(F.col("_to").alias(ROWID), "_value")
        if isinstance(rows, slice):
            a, b, step = slice_bounds(rows, self.nrows)
            rows = list(range(a, b, step))
        last = dict(zip(rows, values, strict=True))
        frame = self.spark.createDataFrame(list(last.items()), [ROWID, "_value"])
        return frame.select(F.col(ROWID).cast("long"), spec.coerce(F.col("_value")).alias("_value"))

    def resize(self, nrows: int) -> None:
        """Cut the table after ``nrows`` rows, or add rows of fill values up to it."""
        self.check_writable("resize")
        if nrows < 0:
            raise ValueError("a table can't have fewer than 0 rows")
        files = self._state["files"]
        if nrows < self.nrows:
            kept = [f for f in files if f["high"] < nrows]
            if cut := [f for f in files if f["low"] < nrows <= f["high"]]:
                kept += self._write(self.frame(cut).filter(F.col(ROWID) < nrows), [(cut[0]["low"], nrows - cut[0]["low"], [])])
        elif nrows > self.nrows:
            fills = [c.fill_column().alias(c.name) for c in self.spec.values()]
            kept = [*files, *self._write(self.spark.range(self.nrows, nrows).select(F.col("id").alias(ROWID), *fills), [(self.nrows, nrows - self.nrows, [])])]
        else:
            return
        self._commit(files=kept, nrows=nrows)

    def verify(self) -> None:
        """The files' ranges must cover all positions once, and the files must be there with the rows and positions that the manifest says."""
        self._check_ranges()
        files = self._state["files"]
        if not files:
            return
        try:
            read = self.spark.read.schema(f"{ROWID} long").parquet(*[self.files.at(f["path"]) for f in files])
            by_file = read.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(ROWID).alias("low"), F.max(ROWID).alias("high"), F.count(F.lit(1)).alias("n"))
            found = {r["file"]: (r["low"], r["high"], r["n"]) for r in by_file.collect()}
        except (PySparkException, Py4JJavaError) as e:
            raise ValueError(f"files of {self.path} are lost or damaged: {str(e).splitlines()[0]}") from e
        for f in files:
            if found.get(name := f["path"].rpartition("/")[2]) != (f["low"], f["high"], f["n"]):
                raise ValueError(f"{name} of {self.path} holds {found.get(name)}, the manifest says {(f['low'], f['high'], f['n'])}")

    def _check_ranges(self) -> None:
        at = 0
        for f in sorted(self._state["files"], key=lambda f: f["low"]):
            if f["low"] != at or f["high"] - f["low"] + 1 != f["n"]:
                raise ValueError(f"rows {at} to {f['low']} are not there once in {self.path}")
            at = f["high"] + 1
        if at != self.nrows:
            raise ValueError(f"{self.path} has {at} rows, the manifest says {self.nrows}")

    def vacuum(self) -> None:
        """Compact the data into files of one version, if they are of several, and remove all that the version does not need."""
        self.check_writable("vacuum")
        files = self._state["files"]
        columns = self._state["columns"]
        if len({f["path"].split("/")[1] for f in files}) > 1 or any(c["since"] > f["version"] for c in columns for f in files[:1]):
            self._commit(files=self._write(self.frame(), [(0, self.nrows, [])]), touched=[])
        used = {f["path"].split("/")[1] for f in self._state["files"]}
        for name in self.files.names("data"):
            if name not in used:
                self.files.delete(f"data/{name}")
        indexes = {x["path"].split("/")[1] for x in self._state["indexes"].values()}
        for name in self.files.names("index"):
            if name not in indexes:
                self.files.delete(f"index/{name}")
        for name in self.files.names("manifest"):
            if name != f"{self.version:010d}.json":
                self.files.delete(f"manifest/{name}")

    @contextmanager
    def updating(self, vacuum: bool = False):
        """Changes inside put off the rebuilding of indexes to the end."""
        self.check_writable("update")
        self._vacuum_on_exit = self._vacuum_on_exit or vacuum
        self.__enter__()
        try:
            yield self
        finally:
            self.__exit__()

    def __enter__(self) -> Table:
        self._depth += 1
        return self

    def __exit__(self, *args: object) -> None:
        self._depth -= 1
        if not self._depth:
            self._refresh_indexes()
            if self._vacuum_on_exit:
                self._vacuum_on_exit = False
                self.vacuum()

    # ---- indexes

    def has_index(self, column: str) -> bool:
        return column in self._state["indexes"]

    def index_is_fresh(self, column: str) -> bool:
        return self.has_index(column) and self._state["indexes"][column]["fresh"]

    def create_index(self, column: str, overwrite: bool = False) -> None:
        """A projection (value, position) sorted by value, in files whose ranges of values don't overlap."""
        self.check_writable("create an index")
        self._checked(column)
        if self.has_index(column) and not overwrite:
            raise RuntimeError(f"column {column!r} has an index")
        name = f"index/{column}-{uuid.uuid4().hex}"
        pairs = self.frame().select(F.col(column).alias("value"), ROWID)
        width = types.width_bytes(self.spec[column].dtype) + 8
        parts = -(-self.nrows // rows_per_file(self.nrows, width)) or 1
        pairs.repartitionByRange(parts, "value", ROWID).sortWithinPartitions("value", ROWID).write.option("compression", "zstd").parquet(self.files.at(name))
        depth, self._depth = self._depth, 1
        try:
            self._commit(indexes={**self._state["indexes"], column: {"path": name, "fresh": True}})
        finally:
            self._depth = depth

    def update_index(self, column: str) -> None:
        if not self.has_index(column):
            raise RuntimeError(f"column {column!r} has no index")
        self.create_index(column, overwrite=True)

    def delete_index(self, column: str) -> None:
        self.check_writable("delete an index")
        if self.has_index(column):
            gone = self._state["indexes"][column]["path"]
            self._commit(indexes={c: x for c, x in self._state["indexes"].items() if c != column})
            self.files.delete(gone)

    def _refresh_indexes(self) -> None:
        for column in [c for c, x in self._state["indexes"].items() if not x["fresh"]]:
            self.update_index(column)

    def index_frame(self, column: str) -> DataFrame:
        """The index projection, the value under the column's name."""
        if not self.has_index(column):
            raise RuntimeError(f"column {column!r} has no index")
        schema = T.StructType([T.StructField("value", self.spec[column].spark_type), T.StructField(ROWID, T.LongType())])
        return self.spark.read.schema(schema).parquet(self.files.at(self._state["indexes"][column]["path"])).withColumnRenamed("value", column)

    def index_size_bytes(self, column: str) -> int:
        return self.files.size(self._state["indexes"][column]["path"]) if self.has_index(column) else 0

    def index_filenames(self, column: str) -> list[str]:
        """The files of a column's index, none without one."""
        if not self.has_index(column):
            return []
        path = self._state["indexes"][column]["path"]
        return [self.files.at(f"{path}/{n}") for n in self.files.names(path) if n.endswith(".parquet")]

    # ---- namespace

    def create_table(self, schema: TableSpec | None = None, name: str | None = None, yes: bool = False) -> Table:
        """An empty table with a schema: this one, or a sub-table by path ("a/", "a/b/")."""
        self.check_writable("create a table")
        here = self
        if name is not None:
            if name.startswith("/") or not name.endswith("/") or len(name) < 2:
                raise ValueError(f"bad table name {name!r}, it must end and not start with a slash")
            for part in [p for p in name.split("/") if p]:
                if part + "/" not in here.sub_table_names:
                    Table.make(self.spark, here.files.at(part + SUFFIX))
                here = here._child(part)
            if here.column_names:
                if not yes:
                    raise RuntimeError(f"table {name!r} exists; say yes=True to replace it")
                Table.make(self.spark, here.path, yes=True)
                here._load()
        if schema:
            here._add(schema)
        return here

    def from_dataframe(self, data: object, name: str | None = None, compression: object = None, chunksize: object = None, append: bool = True, yes: bool = False) -> Table:
        """A table whose schema is inferred from data, which are then appended."""
        df = self.to_frame(data)
        spec = TableSpec.from_dataframe(df, compression, chunksize)
        widths = _widths(data)
        table = self.create_table(TableSpec(replace(c, dtype=widths.get(c.name, c.dtype)) for c in spec.values()), name, yes)
        if append:
            table.append(df)
        return table

    from_array = from_dataframe

    def create_meta(self, name: str, data: object = None) -> None:
        self.check_writable("create metadata")
        if name in set(self.meta):
            raise ValueError(f"metadata {name!r} exists")
        self.files.mkdirs("meta")
        try:
            self.files.write_json(f"meta/{name}.json", {} if data is None else data, replace=False)
        except FileExistsError as e:
            raise ValueError(f"metadata {name!r} exists") from e

    def delete_meta(self, name: str, yes: bool = False) -> None:
        self.check_writable("delete metadata")
        self.meta[name]
        self._confirm(yes, name)
        self.files.delete(f"meta/{name}.json")

    def delete_entry(self, name: str, yes: bool = False) -> None:
        """Drop a column (only the manifest changes) or remove a sub-table."""
        self.check_writable("delete an entry")
        found = self._resolve(name)
        self._confirm(yes, name)
        if isinstance(found, Table):
            if found is self:
                raise ValueError("use delete() for the whole table")
            found.files.delete()
            self._children.clear()
        else:
            t = found.table
            t._commit(columns=[c for c in t._state["columns"] if c["name"] != found.name], indexes={c: x for c, x in t._state["indexes"].items() if c != found.name})

    def delete(self, yes: bool = False) -> None:
        self.check_writable("delete")
        self._confirm(yes, self.path)
        self.files.delete()

    @staticmethod
    def _confirm(yes: bool, what: str) -> None:
        if not yes:
            raise RuntimeError(f"say yes=True to delete {what}")

    def clear(self) -> None:
        raise RuntimeError("a table can't be cleared; use delete")

    def reload(self, columns: Sequence[str] | None = None) -> None:
        """Read the last manifest again and drop what Spark remembers of the files."""
        self._checked(columns)
        self._load()
        self._children.clear()
        self.spark.catalog.refreshByPath(self.path)
        self._check_ranges()

    def register(self, view: str) -> None:
        """A temporary view of the table's columns, for SQL."""
        self.frame().drop(ROWID).createOrReplaceTempView(view)

    def tree(self, full: bool = False, indent: str = "") -> str:
        lines = [f"{indent}{c['name']}  {c['dtype']}" + ("  indexed" if self.has_index(c["name"]) else "") if full else indent + c["name"] for c in self._state["columns"]]
        lines += [f"{indent}{m}  metadata" if full else indent + m for m in self.meta_names]
        for name in self.sub_table_names:
            lines += [indent + name, self._child(name[:-1]).tree(full, indent + "  ")]
        return "\n".join(x for x in lines if x)

    def list(self, full: bool = False) -> None:
        print(self.tree(full))

    def __repr__(self) -> str:
        return f"Table(\n  dir: {self.path}\n  rows: {self.nrows}\n  version: {self.version}\n  mode: {self.mode}\n{self.tree(True, '  ')}\n)"


def _paths(files: list[dict]) -> list[str]:
    """The files' paths; of a folder that is wanted whole, the folder's, which Spark lists by itself."""
    folders: dict[str, list[dict]] = {}
    for f in files:
        folders.setdefault(f["path"].rpartition("/")[0], []).append(f)
    return [p for d, own in folders.items() for p in ([d] if len(own) == own[0]["of"] else [f["path"] for f in own])]


def _arrow(values: object) -> object:
    """A column for Arrow: texts as Python's, unsigned and half-precision numbers in the next wider type."""
    import pyarrow as pa

    kind = getattr(values, "dtype", None)
    if kind is None or kind.kind in "OUS":
        return pa.array(values.tolist() if kind is not None else list(values))
    wider = {"u1": "i2", "u2": "i4", "u4": "i8", "u8": "i8", "f2": "f4"}.get(kind.str[1:])
    return pa.array(values.astype(wider or kind.newbyteorder("=")))


def _widths(data: object) -> dict[str, str]:
    """Codes with the width of fixed-width text in NumPy arrays."""
    columns = data if isinstance(data, Mapping) else {n: data[n] for n in getattr(getattr(data, "dtype", None), "names", None) or ()}
    kinds = {k: getattr(v, "dtype", None) for k, v in columns.items()}
    return {k: f"{d.kind}{d.itemsize // (4 if d.kind == 'U' else 1)}" for k, d in kinds.items() if d is not None and d.kind in "US"}


def _as_value_error(e: PySparkException) -> Exception:
    """Casts that fail when run are errors of the value."""
    return ValueError(str(e).splitlines()[0]) if any(x in str(e) for x in ("CAST_INVALID_INPUT", "CAST_OVERFLOW", "NumberFormat", "ARITHMETIC_OVERFLOW", "DATATYPE_MISMATCH")) else e
