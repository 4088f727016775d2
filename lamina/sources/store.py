"""Opening, creating and attaching stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import types
from lamina.functions.spec import ColumnSpec, TableSpec
from lamina.operators.rows import ROWID
from lamina.sources.files import Files
from lamina.sources.table import Table


class Store:
    """Ways to a table; the table at a store's root holds its sub-tables."""

    @staticmethod
    def open(spark: SparkSession, path: str, mode: str = "r", cache_mem: str | float = "1g", verbose: bool = False, require_index: bool = False) -> Table:
        return Table(spark, path, mode, cache_mem, verbose, require_index)

    @staticmethod
    def create(spark: SparkSession, path: str, cache_mem: str | float = "1g", verbose: bool = False, yes: bool = False) -> Table:
        Table.make(spark, path, yes)
        return Table(spark, path, "r+", cache_mem, verbose)

    @staticmethod
    def create_from_dataframe(spark: SparkSession, path: str, data: object, name: str | None = None, compression: object = None, chunksize: object = None, append: bool = True, yes: bool = False) -> Table:
        store = Store.create(spark, path, yes=yes)
        store.from_dataframe(data, name, compression, chunksize, append)
        return store

    create_from_array = create_from_dataframe

    @staticmethod
    def attach(spark: SparkSession, path: str) -> Attached:
        """Parquet files or folders ``NAME.parquet`` below a path, as read-only tables."""
        return Attached(spark, path)


class ParquetTable(Table):
    """A Parquet file or folder as a read-only table; a row's position is its place in the files by name."""

    type = "parquet"

    def __init__(self, spark: SparkSession, path: str, require_index: bool = False):
        self.spark, self.path, self.mode, self.cache_mem, self.verbose, self.require_index = spark, path, "r", "1g", False, require_index
        self.files = Files(spark, path)
        self._depth, self._children = 0, {}
        self._source = spark.read.parquet(path)
        self._single = len(self._source.inputFiles()) == 1
        columns = [{"name": f.name, "dtype": types.code_of(f.dataType), "physical": f.name, "since": 0} for f in self._source.schema.fields]
        self._state = {"version": 0, "nrows": None, "columns": columns, "files": [], "indexes": {}, "next": 0}

    @property
    def nrows(self) -> int:
        """Counted once, from the footers."""
        if self._state["nrows"] is None:
            self._state["nrows"] = self._source.count()
        return self._state["nrows"]

    size = nrows

    @property
    def spec(self) -> TableSpec:
        return TableSpec(ColumnSpec(c["name"], c["dtype"]) for c in self._state["columns"])

    column_names = property(lambda self: self._source.columns)
    sub_table_names = property(lambda self: [])
    meta_names = property(lambda self: [])
    filenames = property(lambda self: sorted(self._source.inputFiles()))

    def frame(self, files: object = None) -> DataFrame:
        """One file's rows carry their own numbers; of several, each gets the rows of those before it added."""
        index = F.col("_metadata.row_index")
        if self._single:
            return self._source.withColumn(ROWID, index)
        counts = self._source.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        placed = self._source.withColumns({"_file": F.col("_metadata.file_path"), "_index": index})
        # a row for each file, as many as the driver's own list of them
        joined = placed.join(F.broadcast(starts), "_file")
        return joined.withColumn(ROWID, F.col("_start") + F.col("_index")).drop("_file", "_index", "_start")

    def read(self, columns: object = None, rows: object = None, asdict: bool = False) -> object:
        from pyspark.sql import Column

        from lamina.operators.predicates import RowSet

        expr = rows.expr if isinstance(rows, RowSet) and rows.table is self else rows if isinstance(rows, Column) else None
        if rows is None or expr is not None:
            # no positions are needed: a plain scan with pushed filters
            out = self._source.select(*self._checked(columns)) if expr is None else self._source.filter(expr).select(*self._checked(columns))
            return self.to_arrays(out) if asdict else out
        return super().read(columns, rows, asdict)

    def __repr__(self) -> str:
        return f"ParquetTable({self.path})"

    def verify(self) -> None:
        pass


class Attached:
    """A folder of Parquet tables by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._tables: dict[str, ParquetTable] = {}

    @property
    def sub_table_names(self) -> list[str]:
        return [n[: -len(".parquet")] + "/" for n in Files(self.spark, self.path).names() if n.endswith(".parquet")]

    names = sub_table_names

    def __getitem__(self, path: str) -> object:
        name, _, rest = path.strip("./").partition("/")
        if name not in self._tables:
            if name + "/" not in self.sub_table_names:
                raise IndexError(f"no table {name!r} in {self.path}")
            self._tables[name] = ParquetTable(self.spark, f"{self.path}/{name}.parquet")
        return self._tables[name][rest] if rest else self._tables[name]

    def __contains__(self, path: object) -> bool:
        try:
            return isinstance(path, str) and self[path] is not None
        except IndexError:
            return False

    def __repr__(self) -> str:
        return f"Attached({self.path})"
