"""Queries over the column store, one for each operator, with their SQL.

Reads run on the Parquet tables of a folder as they are. Changes run on a store
in the session's shared folder that is made from one of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.spec import ColumnSpec, TableSpec
from lamina.operators.predicates import RowSet
from lamina.operators.rows import ROWID
from lamina.sources.store import ParquetTable, Store
from lamina.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str, query: Query) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _on(table: str, make: Callable[[ParquetTable], DataFrame]) -> Query:
    return lambda spark, sf: make(Store.attach(spark, sf)[table])


def _scratch(spark: SparkSession) -> str:
    """A fresh path for a store: in the folder that all executors share; where none is named, a temporary one if they are one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lamina-")
    return f"{shared}/store-{uuid.uuid4().hex}"


def _stored(table: str, change: Callable[[Table], DataFrame], columns: list[str] | None = None) -> Query:
    """A query over a store made from a table in the order of its positions."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        source = Store.attach(spark, sf)[table]
        data = source.frame().orderBy(ROWID).select(*(columns or source.column_names))
        return change(Store.create_from_dataframe(spark, _scratch(spark), data))

    return run


def _rows(df: DataFrame) -> DataFrame:
    """With the position as a column of the result."""
    return df.withColumnRenamed(ROWID, "rid")


_ORDERS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid, count(*) OVER () AS n FROM orders)"
_SUPPLIER = "(SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS rid, count(*) OVER () AS n FROM supplier)"
_TWO = ["o_orderkey", "o_totalprice"]
_PICK = "SELECT o_orderkey, o_totalprice FROM orders WHERE "

# ---- scans and projections
_add("scan_all", "SELECT * FROM supplier", _on("supplier", lambda t: t[:]))
_add("project", "SELECT o_orderkey, o_totalprice FROM orders", _on("orders", lambda t: t[_TWO][:]))
_add("column_scan", "SELECT p_retailprice FROM part", _on("part", lambda t: t["p_retailprice"][:]))
_add("table_nrows", "SELECT count(*) AS nrows FROM lineitem", lambda spark, sf: spark.createDataFrame([(Store.attach(spark, sf)["lineitem"].nrows,)], "nrows long"))

# ---- rows by position
for _name, _get, _where in (
    ("row_slice", slice(10, 20), "rid >= 10 AND rid < 20"),
    ("row_slice_negative", slice(-5, -2), "rid >= n - 5 AND rid < n - 2"),
    ("row_slice_step", slice(2, 180, 7), "rid >= 2 AND rid < 180 AND (rid - 2) % 7 = 0"),
    ("row_slice_past_end", slice(10**9, None), "false"),
    ("row_list", [8, 9, 15], "rid IN (8, 9, 15)"),
    ("row_list_negative", [-3, -1], "rid IN (n - 3, n - 1)"),
    ("row_scalar", 5, "rid = 5"),
):
    _add(_name, f"SELECT * EXCLUDE (rid, n) FROM {_ORDERS} WHERE {_where}", _on("orders", lambda t, r=_get: t[r]))
_add(
    "row_list_dup_unsorted",
    f"SELECT o_orderkey, o_totalprice FROM {_ORDERS} JOIN (VALUES (0, 17), (1, 5), (2, 5)) AS w(pos, rid) USING (rid)",
    _on("orders", lambda t: t[_TWO][[17, 5, 5]]),
)
_add("project_rows", f"SELECT o_orderkey, o_totalprice FROM {_ORDERS} WHERE rid IN (1, 4, 90)", _on("orders", lambda t: t.read(_TWO, [1, 4, 90])))

# ---- predicates
for _name, _sql, _pred in (
    ("pred_gt", "o_totalprice > 250000.0", lambda t: t["o_totalprice"] > 250000.0),
    ("pred_ge", "o_orderkey >= 700", lambda t: t["o_orderkey"] >= 700),
    ("pred_lt", "o_totalprice < 50000.0", lambda t: t["o_totalprice"] < 50000.0),
    ("pred_le", "o_orderkey <= 700", lambda t: t["o_orderkey"] <= 700),
    ("pred_eq", "o_orderkey = 77", lambda t: t["o_orderkey"] == 77),
    ("pred_ne", "o_orderstatus <> 'F'", lambda t: t["o_orderstatus"] != "F"),
    ("pred_str_range", "o_orderpriority >= '2-HIGH' AND o_orderpriority < '4'", lambda t: t["o_orderpriority"].between("2-HIGH", "4", "[)")),
    ("match_int", "o_orderkey IN (5, 17, 900)", lambda t: t["o_orderkey"].match([5, 17, 900])),
    ("match_dup_values", "o_orderkey IN (5, 17)", lambda t: t["o_orderkey"].match([17, 5, 17, 5])),
    ("match_str", "o_orderstatus IN ('O', 'P')", lambda t: t["o_orderstatus"].match(["O", "P"])),
    ("and_preds", "o_orderkey BETWEEN 100 AND 500 AND o_totalprice > 200000.0", lambda t: t["o_orderkey"].between(100, 500) & (t["o_totalprice"] > 200000.0)),
    ("or_preds", "o_orderkey < 50 OR o_orderstatus = 'P'", lambda t: (t["o_orderkey"] < 50) | (t["o_orderstatus"] == "P")),
    (
        "and_or_nested",
        "(o_orderkey < 600 AND o_totalprice >= 100000.0) OR (o_orderstatus = 'P' AND o_orderkey > 900)",
        lambda t: ((t["o_orderkey"] < 600) & (t["o_totalprice"] >= 100000.0)) | ((t["o_orderstatus"] == "P") & (t["o_orderkey"] > 900)),
    ),
    ("not_pred", "NOT (o_totalprice > 50000.0)", lambda t: ~(t["o_totalprice"] > 50000.0)),
    (
        "rowset_materialized_and",
        "o_orderkey < 600 AND o_totalprice > 100000.0",
        lambda t: (t["o_orderkey"] < 600).materialized() & (t["o_totalprice"] > 100000.0).materialized(),
    ),
    ("rowset_materialized_or", "o_orderkey < 60 OR o_totalprice > 400000.0", lambda t: (t["o_orderkey"] < 60).materialized() | (t["o_totalprice"] > 400000.0)),
    ("rowset_from_rows", "o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3)", lambda t: RowSet.from_rows(t, [2, 0, 1, 0])),
):
    _add(_name, _PICK + _sql, _on("orders", lambda t, p=_pred: t[_TWO][p(t)]))
for _name, _interval, _sql in (
    ("between_cc", "[]", "l_quantity >= 10 AND l_quantity <= 12"),
    ("between_co", "[)", "l_quantity >= 10 AND l_quantity < 12"),
    ("between_oc", "(]", "l_quantity > 10 AND l_quantity <= 12"),
    ("between_oo", "()", "l_quantity > 10 AND l_quantity < 12"),
):
    _add(
        _name,
        f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_sql}",
        _on("lineitem", lambda t, i=_interval: t[["l_orderkey", "l_linenumber", "l_quantity"]][t["l_quantity"].between(10.0, 12.0, i)]),
    )
_add("between_inverted", _PICK + "false", _on("orders", lambda t: t[_TWO][t["o_orderkey"].between(500, 100)]))
_add("pred_str_eq", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", _on("customer", lambda t: t[["c_custkey", "c_mktsegment"]][t["c_mktsegment"] == "BUILDING"]))
_add(
    "pred_timestamp_range",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'",
    _on("events", lambda t: t[["event_id", "ts"]][t["ts"].between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"), "[)")]),
)
_add(
    "pred_le_max_large",
    "SELECT count(*) AS n FROM lineitem WHERE l_orderkey <= (SELECT max(l_orderkey) FROM lineitem)",
    _on("lineitem", lambda t: t.where(t["l_orderkey"] <= t["l_orderkey"][:].agg(F.max("l_orderkey")).first()[0]).agg(F.count(F.lit(1)).alias("n"))),
)

# ---- sets of rows
_add("rowset_ids", f"SELECT rid FROM {_ORDERS} WHERE o_totalprice > 450000.0", _on("orders", lambda t: _rows((t["o_totalprice"] > 450000.0).sorted())))
_add(
    "rowset_minmax",
    f"SELECT min(rid) AS low, max(rid) AS high FROM {_ORDERS} WHERE o_totalprice > 450000.0",
    _on("orders", lambda t: t.spark.createDataFrame([(t["o_totalprice"] > 450000.0).minmax()], "low long, high long")),
)
_add("rowset_by_value", f"SELECT rid FROM {_ORDERS} WHERE o_totalprice < 20000.0", _on("orders", lambda t: _rows((t["o_totalprice"] < 20000.0).by_value())))

# ---- indexes


def _indexed(t: Table) -> DataFrame:
    t.create_index("s_acctbal")
    return _rows(t.index_frame("s_acctbal"))


def _index_after_update(t: Table) -> DataFrame:
    t.create_index("s_nationkey")
    with t.updating():
        t["s_nationkey"][2:6] = 3
    return _rows((t["s_nationkey"] == 3).by_value())


_add("index_projection", f"SELECT s_acctbal, rid FROM {_SUPPLIER}", _stored("supplier", _indexed))
_add("index_after_update", f"SELECT rid FROM {_SUPPLIER} WHERE (rid >= 2 AND rid < 6) OR s_nationkey = 3", _stored("supplier", _index_after_update))

# ---- changes; results have the positions


def _changed(change: Callable[[Table], object]) -> Callable[[Table], DataFrame]:
    def run(t: Table) -> DataFrame:
        change(t)
        return _rows(t.frame())

    return run


_S = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def _sql_set(column: str, expr: str) -> str:
    return f"SELECT {', '.join(c if c != column else f'{expr} AS {c}' for c in _S)}, rid FROM {_SUPPLIER}"


def _put(column: str, rows: object, values: object) -> Callable[[Table], None]:
    return lambda t: t[column].__setitem__(rows(t) if callable(rows) else rows, values)


for _name, _column, _rows_of, _values, _expr in (
    ("update_slice_fill", "s_acctbal", slice(2, 7), 1.5, "CASE WHEN rid >= 2 AND rid < 7 THEN 1.5 ELSE s_acctbal END"),
    ("update_slice_array", "s_nationkey", slice(0, 4), [9, 8, 7, 6], "CASE WHEN rid < 4 THEN CAST(9 - rid AS INTEGER) ELSE s_nationkey END"),
    ("update_slice_step", "s_nationkey", slice(1, 9, 3), [1, 2, 3], "CASE WHEN rid IN (1, 4, 7) THEN CAST((rid - 1) // 3 + 1 AS INTEGER) ELSE s_nationkey END"),
    ("update_rows_fill", "s_name", [8, 1, -1], "x", "CASE WHEN rid IN (1, 8, n - 1) THEN 'x' ELSE s_name END"),
    ("update_rows_array", "s_nationkey", [6, 3], [60, 30], "CASE WHEN rid = 6 THEN 60 WHEN rid = 3 THEN 30 ELSE s_nationkey END"),
    ("update_row", "s_nationkey", 4, 44, "CASE WHEN rid = 4 THEN 44 ELSE s_nationkey END"),
    ("update_pred", "s_nationkey", lambda t: t["s_acctbal"] < 0.0, -1, "CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END"),
    ("update_column", "s_nationkey", None, 12, "12"),
):
    _add(_name, _sql_set(_column, _expr), _stored("supplier", _changed(_put(_column, _rows_of, _values))))
_add("append_rows", f"SELECT * EXCLUDE n FROM {_SUPPLIER} UNION ALL SELECT * EXCLUDE (rid, n), rid + n AS rid FROM {_SUPPLIER}", _stored("supplier", _changed(lambda t: t.append(t.ordered()))))
_add("add_column_fill", f"SELECT * EXCLUDE n, CAST(9.5 AS DOUBLE) AS x9 FROM {_SUPPLIER}", _stored("supplier", _changed(lambda t: t.create_column(ColumnSpec("x9", "f8", fill_value=9.5)))))
_add("add_column_default", f"SELECT * EXCLUDE n, 0 AS zero, '' AS empty FROM {_SUPPLIER}", _stored("supplier", _changed(lambda t: (t.create_column(ColumnSpec("zero", "i4")), t.create_column(ColumnSpec("empty", "U2"))))))
_add("drop_column", f"SELECT * EXCLUDE (n, s_name) FROM {_SUPPLIER}", _stored("supplier", _changed(lambda t: t.delete_entry("s_name", yes=True))))
_add("resize_truncate", f"SELECT * EXCLUDE n FROM {_SUPPLIER} WHERE rid < 6", _stored("supplier", _changed(lambda t: t.resize(6))))
_add(
    "resize_extend",
    f"SELECT * EXCLUDE n FROM {_SUPPLIER} UNION ALL SELECT 0, '', 0, 0.0, (SELECT count(*) FROM supplier) + i FROM range(3) AS r(i)",
    _stored("supplier", _changed(lambda t: t.resize(t.nrows + 3))),
)


def _coerced(dtype: str, source: str) -> Callable[[Table], DataFrame]:
    def run(t: Table) -> DataFrame:
        t.create_column(ColumnSpec("made", dtype))
        t["made"][:] = t[source][:]
        return t.read(["o_orderkey", "made"])

    return run


_add("coerce_num_to_str", "SELECT o_orderkey, substr(CAST(o_custkey AS VARCHAR), 1, 3) AS made FROM orders", _stored("orders", _coerced("U3", "o_custkey"), ["o_orderkey", "o_custkey"]))
_add("coerce_float_to_int", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS made FROM orders", _stored("orders", _coerced("i8", "o_totalprice"), ["o_orderkey", "o_totalprice"]))


def _vacuumed(t: Table) -> DataFrame:
    with t.updating(vacuum=True):
        t["s_nationkey"][1:3] = 5
        t["s_acctbal"][[0, 4]] = [1.0, 2.0]
    return _rows(t.frame())


_add(
    "vacuum_roundtrip",
    f"SELECT s_suppkey, s_name, CASE WHEN rid IN (1, 2) THEN 5 ELSE s_nationkey END AS s_nationkey, CASE rid WHEN 0 THEN 1.0 WHEN 4 THEN 2.0 ELSE s_acctbal END AS s_acctbal, rid FROM {_SUPPLIER}",
    _stored("supplier", _vacuumed),
)


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    store = Store.create(spark, _scratch(spark))
    store.from_dataframe(Store.attach(spark, sf)["nation"][:], "geo/nations/")
    return store["geo/nations/"][["n_nationkey", "n_name"]][store["geo/nations/n_regionkey"] == 2]


_add("subtable_path", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", _nested)


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    from lamina.sources.ingest import from_file

    return from_file(spark, _scratch(spark), f"{sf}/region.parquet", lower=True)[:]


_add("ingest_file", "SELECT r_regionkey, r_name FROM region", _ingested)


def _sql_view(spark: SparkSession, sf: str) -> DataFrame:
    Store.attach(spark, sf)["part"].register("lamina_part")
    return spark.sql("SELECT p_partkey, p_size FROM lamina_part WHERE p_size > 40")


_add("sql_view", "SELECT p_partkey, p_size FROM part WHERE p_size > 40", _sql_view)


# ---- opening, reading to the driver, schemas


def _frame(t: Table, rows: list, schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _texts(t: Table, values: dict[str, object]) -> DataFrame:
    """Facts by name, as text."""
    return _frame(t, [(k, str(v)) for k, v in values.items()], "name string, value string")


def _facts(**values: str) -> str:
    """SQL for facts by name; a value is an SQL expression."""
    return " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS VARCHAR) AS value" for k, v in values.items())


def _refused(*calls: Callable[[], object]) -> int:
    """How many of the calls raise an error."""
    count = 0
    for call in calls:
        try:
            call()
        except (OSError, RuntimeError, ValueError, TypeError, IndexError):
            count += 1
    return count


def _reopened(t: Table) -> DataFrame:
    return Store.open(t.spark, t.path)[:]


_add("store_opened", "SELECT * FROM supplier", _stored("supplier", _reopened))


def _as_dict(t: Table) -> DataFrame:
    found = t.read(["r_regionkey", "r_name"], asdict=True)
    return _frame(t, list(zip(found["r_regionkey"].tolist(), found["r_name"].tolist(), strict=True)), "r_regionkey int, r_name string")


_add("read_dict", "SELECT r_regionkey, r_name FROM region", _on("region", _as_dict))


def _buffers(t: Table) -> DataFrame:
    import numpy as np

    some, one, every = np.zeros(3, "i8"), np.zeros(1, "i8"), np.zeros(t.nrows, "i8")
    t["o_custkey"].read_rows_into([7, 3, 3], some)
    t["o_custkey"].read_row_into(11, one)
    t["o_custkey"].read_into(every)
    return _frame(t, [(0, v) for v in some.tolist()] + [(1, v) for v in one.tolist()] + [(2, int(every.sum()))], "k int, v long")


_add(
    "read_buffers",
    f"SELECT 0 AS k, o_custkey AS v FROM {_ORDERS} JOIN (VALUES (0, 7), (1, 3), (2, 3)) AS w(pos, rid) USING (rid) UNION ALL SELECT 1, o_custkey FROM {_ORDERS} WHERE rid = 11"
    " UNION ALL SELECT 2, CAST(sum(o_custkey) AS BIGINT) FROM orders",
    _on("orders", _buffers),
)


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers written as a FITS table, keys with an offset as unsigned numbers have it, balances scaled, and read again."""
    import numpy as np

    from lamina.sources.files import Files
    from lamina.sources.fits import table_bytes
    from lamina.sources.ingest import from_fits

    rows = Store.attach(spark, sf)["supplier"].read(["s_suppkey", "s_nationkey", "s_name"], asdict=True)
    n = len(rows["s_suppkey"])
    names = np.array([x.encode() for x in rows["s_name"].tolist()])
    fields = [
        ("s_suppkey", "J", (rows["s_suppkey"] - (1 << 31)).astype(">i4"), {"TZERO": 1 << 31}),
        ("pair", "2I", np.stack([rows["s_nationkey"], 2 * rows["s_nationkey"]], axis=1).astype(">i2"), {}),
        ("half", "I", rows["s_nationkey"].astype(">i2"), {"TSCAL": 0.5, "TZERO": 1}),
        ("s_name", f"{names.dtype.itemsize}A", names, {}),
    ]
    path = _scratch(spark)
    Files(spark, path).write_bytes("t.fits", table_bytes(fields, n))
    t = from_fits(spark, f"{path}/out", Files(spark, path).at("t.fits"))
    return t[:].select("s_suppkey", "s_name", "half", F.col("pair")[0].alias("p0"), F.col("pair")[1].alias("p1"))


_add(
    "ingest_fits",
    "SELECT s_suppkey, s_name, s_nationkey * 0.5 + 1 AS half, CAST(s_nationkey AS SMALLINT) AS p0, CAST(2 * s_nationkey AS SMALLINT) AS p1 FROM supplier",
    _fits,
)
_SPEC = [("s_suppkey", "i8"), ("s_name", "U"), ("s_nationkey", "i4"), ("s_acctbal", "f8")]
_SPEC_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in _SPEC) + ") AS s(name, code)"
_add("schema_codes", _SPEC_SQL, _stored("supplier", lambda t: _frame(t, [(c.name, c.dtype) for c in t.spec.values()], "name string, code string")))


def _built(t: Table) -> DataFrame:
    """A schema from a dict, one from columns and one from a frame, and the table that each makes."""
    wanted = dict(_SPEC)
    specs = [TableSpec.from_dict({n: {"dtype": k} for n, k in wanted.items()}), TableSpec.from_columns(ColumnSpec(n, k) for n, k in wanted.items()), TableSpec.from_dataframe(t[:], compression=["s_name"])]
    rows = []
    for k, spec in enumerate(specs):
        made = t.create_table(spec, f"made{k}/")
        made.append(t.ordered())
        rows += [(k, c.name, c.dtype, c.compression is not None, made.nrows) for c in made.spec.values()]
    return _frame(t, rows, "k int, name string, code string, compressed boolean, n long")


_add(
    "schema_builders",
    f"SELECT k, name, code, k = 2 AND name = 's_name' AS compressed, (SELECT count(*) FROM supplier) AS n FROM ({_SPEC_SQL}), (VALUES (0), (1), (2)) AS x(k)",
    _stored("supplier", _built),
)


def _reloaded(t: Table) -> DataFrame:
    other = Store.open(t.spark, t.path)
    t.append(t.ordered())
    before = other.nrows
    other.reload()
    return _frame(t, [(before, other.nrows, other.version == t.version)], "old long, new long, same boolean")


_add("reload", "SELECT count(*) AS old, 2 * count(*) AS new, true AS same FROM supplier", _stored("supplier", _reloaded))
_add("column_scalar", f"SELECT o_totalprice AS a, (SELECT o_totalprice FROM {_ORDERS} WHERE rid = n - 2) AS b FROM {_ORDERS} WHERE rid = 5",
     lambda spark, sf: (lambda t: _frame(t, [(t["o_totalprice"][5], t["o_totalprice"][-2])], "a double, b double"))(Store.attach(spark, sf)["orders"]))

# ---- states of sets, indexes and files
_add("rowset_repr", _facts(expr="'true'", positions="'true'"),
     _stored("supplier", lambda t: _texts(t, {"expr": str("s_nationkey" in repr(t["s_nationkey"] > 3)).lower(), "positions": str("positions" in repr(RowSet.from_rows(t, [1]))).lower()})))


def _index_deleted(t: Table) -> DataFrame:
    t.create_index("s_acctbal")
    t.delete_index("s_acctbal")
    gone = not t.has_index("s_acctbal") and t["s_acctbal"].index_filenames == [] and _refused(lambda: t.index_frame("s_acctbal")) == 1
    return t[["s_suppkey", "s_acctbal"]][t["s_acctbal"] > 1000.0].withColumn("gone", F.lit(gone))


_add("index_deleted", "SELECT s_suppkey, s_acctbal, true AS gone FROM supplier WHERE s_acctbal > 1000.0", _stored("supplier", _index_deleted))


def _index_state(t: Table) -> DataFrame:
    t.create_index("s_acctbal")
    with t.updating():
        t["s_acctbal"][0] = 1.0
        stale = not t.index_is_fresh("s_acctbal")
    named = all(f.endswith(".parquet") for f in t["s_acctbal"].index_filenames)
    sized = t["s_acctbal"].index_size_bytes > 0 and t["s_acctbal"].data_size_bytes == 8 * t.nrows and t["s_acctbal"].index_dtype == [("value", "f8"), ("row", "i8")]
    again = _refused(lambda: t.create_index("s_acctbal"), lambda: t.update_index("s_name"))
    return _frame(t, [(c, t.has_index(c), t.index_is_fresh(c), stale, named and sized, again) for c in t.column_names], "name string, has boolean, fresh boolean, stale boolean, sized boolean, refused int")


_add("index_state", f"SELECT name, name = 's_acctbal' AS has, name = 's_acctbal' AS fresh, true AS stale, true AS sized, 2 AS refused FROM ({_SPEC_SQL})", _stored("supplier", _index_state))


def _verified(t: Table) -> DataFrame:
    """Whole after changes; with a file lost, refused."""
    t["s_name"][2:4] = "x"
    t.append(t.ordered())
    t.verify()
    n = t.nrows
    t.files.delete(t._state["files"][0]["path"])
    return _frame(t, [(n, _refused(t.verify))], "n long, refused int")


_add("verify_files", "SELECT 2 * count(*) AS n, 1 AS refused FROM supplier", _stored("supplier", _verified))

# ---- deletion, metadata, names, modes


def _meta_documents(t: Table) -> DataFrame:
    t.create_meta("info", {"version": "0.1", "seeing": 0.9})
    t.meta["info"].update({"x": 5, "name": "joe"})
    t.create_meta("list")
    t.meta["list"].write([3, 4])
    found = Store.open(t.spark, t.path).meta
    return _texts(t, {**found["info"].read(), "list": found["list"].read(), "names": ",".join(sorted(found))})


_add("meta_documents", _facts(version="'0.1'", seeing="'0.9'", x="'5'", name="'joe'", list="'[3, 4]'", names="'info,list'"), _stored("supplier", _meta_documents))


def _meta_rules(t: Table) -> DataFrame:
    t.create_meta("a", {"x": 1})
    reader = Store.open(t.spark, t.path)
    calls = (
        lambda: t.create_meta("a"), lambda: t.meta.__setitem__("a", {}), lambda: t.meta["none"], lambda: t.delete_meta("a"), lambda: t.delete_meta("none", yes=True),
        lambda: reader.create_meta("b"), lambda: reader.meta["a"].write({}), lambda: reader.meta["a"].update({}), lambda: reader.delete_meta("a", yes=True),
    )
    return _texts(t, {"refused": _refused(*calls), "kept": t.meta["a"].read()["x"]})


_add("meta_rules", _facts(refused="'9'", kept="'1'"), _stored("supplier", _meta_rules))


def _meta_deleted(t: Table) -> DataFrame:
    for name in ("a", "b", "c"):
        t.create_meta(name, {"n": name})
    t.delete_meta("b", yes=True)
    return _frame(t, [(m, t.meta[m].read()["n"]) for m in t.meta_names], "name string, value string")


_add("meta_deleted", "SELECT * FROM (VALUES ('a', 'a'), ('c', 'c')) AS m(name, value)", _stored("supplier", _meta_deleted))


def _deleted(t: Table) -> DataFrame:
    refused = _refused(t.delete)
    there = Store.open(t.spark, t.path).nrows
    t.delete(yes=True)
    return _texts(t, {"refused": refused, "rows_before": there, "refused_after": _refused(lambda: Store.open(t.spark, t.path))})


_add("store_deleted", _facts(refused="'1'", rows_before="(SELECT count(*) FROM supplier)", refused_after="'1'"), _stored("supplier", _deleted))
_add("clear_refused", "SELECT *, 1 AS refused FROM supplier", _stored("supplier", lambda t: t[:].withColumn("refused", F.lit(_refused(t.clear)))))


def _names(t: Table) -> DataFrame:
    t.from_dataframe(t[["s_name"]][:], "sub/deep/")
    t.create_meta("info")
    kinds = [(n, "column") for n in t.column_names] + [(n, "table") for n in t.sub_table_names] + [(n, "meta") for n in t.meta_names]
    return _frame(t, kinds + [(n, "deep") for n in t["sub/"].names], "name string, kind string")


_add("names", f"SELECT name, 'column' AS kind FROM ({_SPEC_SQL}) UNION ALL SELECT * FROM (VALUES ('sub/', 'table'), ('info', 'meta'), ('deep/', 'deep')) AS x(name, kind)", _stored("supplier", _names))


def _listing(t: Table) -> DataFrame:
    t.create_index("s_acctbal")
    t.create_meta("info")
    return _frame(t, [(line,) for line in t.tree(full=True).splitlines()], "line string")


_add("listing", f"SELECT name || '  ' || code || CASE WHEN name = 's_acctbal' THEN '  indexed' ELSE '' END AS line FROM ({_SPEC_SQL}) UNION ALL SELECT 'info  metadata'", _stored("supplier", _listing))


def _reprs(t: Table) -> DataFrame:
    t.create_meta("info")
    return _texts(t, {"column": repr(t["s_name"]), "meta": repr(t.meta["info"]), "metas": repr(t.meta), "rows": f"  rows: {t.nrows}" in repr(t).splitlines(), "mode": "  mode: r+" in repr(t).splitlines()})


_add(
    "reprs",
    _facts(column="'Column(''s_name'', ''U'', rows: ' || (SELECT count(*) FROM supplier) || ', index: False)'", meta="'Meta(''info'')'", metas="'MetaSet([''info''])'", rows="'True'", mode="'True'"),
    _stored("supplier", _reprs),
)


def _read_only(t: Table) -> DataFrame:
    r = Store.open(t.spark, t.path)
    calls = (
        lambda: r.append(t[:]), lambda: r["s_name"].__setitem__(0, "x"), lambda: r["s_name"].create_index(), r.vacuum, lambda: r.resize(1), lambda: r.delete(yes=True), lambda: r.delete_entry("s_name", yes=True),
        lambda: r.create_column(ColumnSpec("q", "i4")), lambda: r.create_meta("n"), lambda: r.create_table(TableSpec(), "a/"), lambda: r.updating().__enter__(), lambda: Store.open(t.spark, t.path, "w"),
    )
    return r[:].withColumn("refused", F.lit(_refused(*calls)))


_add("read_only", "SELECT *, 12 AS refused FROM supplier", _stored("supplier", _read_only))


def _properties(t: Table) -> DataFrame:
    c = t["s_nationkey"]
    with t.updating():
        inside = t.is_updating
    return _texts(t, {
        "nrows": t.nrows, "size": t.size, "mode": t.mode, "type": t.type, "cache": t.cache_mem_gb, "updating": (inside, t.is_updating), "same_dir": t.dir == t.path, "files": len(t.filenames) > 0,
        "column": (c.name, c.dtype, c.nrows, c.has_index, c.mode, c.data_size_bytes),
    })


_N = "(SELECT count(*) FROM supplier)"
_add(
    "properties",
    _facts(nrows=_N, size=_N, mode="'r+'", type="'table'", cache="'1.0'", updating="'(True, False)'", same_dir="'True'", files="'True'", column=f"'(''s_nationkey'', ''i4'', ' || {_N} || ', False, ''r+'', ' || 4 * {_N} || ')'"),
    _stored("supplier", _properties),
)


def _mapping(t: Table) -> DataFrame:
    t.from_dataframe(t[["s_name"]][:], "sub/")
    found = {"len": len(t), "keys": ",".join(sorted(t)), "has": ("s_name" in t, "sub/s_name" in t, "nothing" in t), "get": (t.get("nothing"), t.get("s_name").name), "items": len(dict(t.items()))}
    return _texts(t, {**found, "refused": _refused(lambda: t["nothing"], lambda: t.__setitem__("sub/", 1))})


_add("mapping", _facts(len="'5'", keys="'s_acctbal,s_name,s_nationkey,s_suppkey,sub/'", has="'(True, True, False)'", get="'(None, ''s_name'')'", items="'5'", refused="'2'"), _stored("supplier", _mapping))


def _handles(t: Table) -> DataFrame:
    """A column's handle in a with block defers index upkeep, as the table's does."""
    t.create_index("s_nationkey")
    with t["s_nationkey"] as c:
        c[0:2] = 77
        stale = not t.index_is_fresh("s_nationkey")
    with t as same:
        same["s_name"][0] = "first"
    return _rows(t.frame()).withColumn("stale", F.lit(stale and t.index_is_fresh("s_nationkey")))


_add(
    "handles",
    f"SELECT s_suppkey, CASE WHEN rid = 0 THEN 'first' ELSE s_name END AS s_name, CASE WHEN rid < 2 THEN 77 ELSE s_nationkey END AS s_nationkey, s_acctbal, rid, true AS stale FROM {_SUPPLIER}",
    _stored("supplier", _handles),
)
