"""Stores: creation, reads, updates, indexes, versions, namespace, metadata, errors."""

import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina import ColumnSpec, RowSet, Store, TableSpec
from lamina.functions import sizes, types
from lamina.operators.rows import slice_bounds
from lamina.sources.files import Files
from lamina.sources.fits import FitsSource
from lamina.sources.ingest import from_file, from_fits
from lamina.streaming import append_stream, batch_writer

N = 20


def data(n=N, seed=333):
    rng = np.random.RandomState(seed)
    return {"id": np.arange(n), "rand": rng.uniform(size=n).astype("f4"), "scol": np.array([f"s{i}" for i in range(n)])}


def structured(n=N):
    d = data(n)
    out = np.zeros(n, [("id", "i8"), ("rand", "f4"), ("scol", "U5")])
    for k, v in d.items():
        out[k] = v
    return out


@pytest.fixture
def store(spark, tmp_path):
    return Store.create_from_array(spark, f"{tmp_path}/s", data())


def values(table, column):
    return [r[0] for r in table.frame().orderBy("_rowid").select(column).collect()]


def col(df):
    return [r[0] for r in df.collect()]


# ---- creation


@pytest.mark.parametrize("compression", [None, True, ["id", "scol"], {"id": True, "scol": {"clevel": 9}}])
@pytest.mark.parametrize("make", [data, structured])
def test_create(spark, tmp_path, compression, make):
    t = Store.create_from_array(spark, f"{tmp_path}/c", make(), compression=compression)
    assert (t.nrows, t.column_names, t.version > 0) == (N, ["id", "rand", "scol"], True)
    assert values(t, "id") == list(range(N)) and values(t, "scol") == data()["scol"].tolist()
    assert bool(t.spec["id"].compression) == bool(compression) and t.spec["id"].dtype == "i8" and t.spec["rand"].dtype == "f4"
    t.append(make())
    assert t.nrows == 2 * N and values(t, "id") == [*range(N), *range(N)]
    again = Store.open(spark, t.path)
    assert values(again, "id") == values(t, "id")
    with pytest.raises(RuntimeError):
        Store.create(spark, t.path)
    assert Store.create(spark, t.path, yes=True).nrows == 0


def test_bad_appends(store):
    for bad in ({"blah": np.zeros(3)}, {**data(3), "extra": np.zeros(3, "i2")}):
        with pytest.raises(ValueError):
            store.append(bad)
    with pytest.raises(ValueError):
        store.append({"id": [1, 2], "rand": [1.0], "scol": ["a", "b"]})
    with pytest.raises(ValueError):
        store.append(np.zeros(3))
    with pytest.raises(ValueError):
        store.append({"id": ["x"], "rand": [1.0], "scol": ["a"]})
    assert store.nrows == N and store.read().count() == N
    store.append({"scol": ["a"], "id": ["7"], "rand": [2]})  # other order, other types
    assert values(store, "id")[-1] == 7


def test_append_many_partitions(spark, store):
    frame = spark.range(1000, 5000, numPartitions=7).select("id", F.lit(0.5).alias("rand"), F.lit("z").alias("scol"))
    store.append(frame)
    assert values(store, "id") == [*range(N), *range(1000, 5000)]
    assert [r[0] for r in store.frame().select("_rowid").orderBy("_rowid").collect()] == list(range(N + 4000))


def test_create_column(store):
    for name, dtype, fill, want in (("newcol", "i4", None, 0), ("news", "U2", None, ""), ("fcol", "U2", "-", "-"), ("x9", "f4", 9.5, 9.5), ("ss", "S3", "yes", b"yes"), ("long", "U2", "abcdef", "ab")):
        store.create_column(ColumnSpec(name, dtype, fill_value=fill))
        assert set(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, values(store, name))) == {want}
    with pytest.raises(RuntimeError):
        store.create_column(ColumnSpec("x9", "f4"))
    store["x9"][3] = 1.0
    store.delete_entry("x9", yes=True)
    store.create_column(ColumnSpec("x9", "i4", fill_value=4))
    assert set(values(store, "x9")) == {4}


def test_types_and_sizes():
    for code in ("i1", "i2", "i4", "i8", "f4", "f8", "b1", "U", "S", "M8", "m8"):
        assert types.code_of(types.spark_type(code)) == code
    assert types.parse("<U5") == ("U", 5) and types.parse("|S3") == ("S", 3) and types.parse("<M8[us]") == ("M8", None) and types.spark_type("u4") == types.spark_type("i8")
    with pytest.raises(ValueError):
        types.spark_type("c16")
    assert sizes.cache_gb("1g") == 1 and sizes.cache_gb("512M") == 0.5 and sizes.cache_gb(2) == 2 and sizes.cache_gb("2") == 2 and sizes.cache_gb("1024kb") == 1 / 1024
    assert sizes.chunk_bytes("1m") == 1 << 20 and sizes.chunk_bytes("100") == 100 and sizes.chunk_bytes("100b") == 100 and sizes.chunk_rows("1000r", 8) == 1000 and sizes.chunk_rows("1m", 8) == (1 << 20) // 16
    with pytest.raises(ValueError):
        sizes.cache_gb("lots")


def test_spec(spark):
    spec = TableSpec.from_dict({"id": {"dtype": "i8"}, "name": {"dtype": "U5", "compression": True, "chunksize": "10m"}, "z": {"dtype": "f4", "compression": {"clevel": 7}}})
    assert spec["id"].compression is None and spec["name"].compression["cname"] == "zstd" and spec["name"].chunksize == "10m"
    assert spec["z"].compression == {"cname": "zstd", "clevel": 7, "shuffle": "bitshuffle"} and spec["z"].chunksize == "1m"
    assert spec.to_struct_type().simpleString() == "struct<id:bigint,name:string,z:float>"
    with pytest.raises(RuntimeError):
        spec.add_column(ColumnSpec("id", "i4"))
    with pytest.raises(ValueError):
        TableSpec.from_dataframe(spark.range(1), chunksize=["1m"])
    with pytest.raises(ValueError):
        ColumnSpec("a/b", "i4")
    assert TableSpec.from_dataframe(spark.range(1), True, {"id": "5r"})["id"].chunksize == "5r"


# ---- reads


def test_reads(store):
    d = data()
    assert col(store["id"][3:6]) == [3, 4, 5] and col(store["scol"][[8, 1, 8]]) == ["s8", "s1", "s8"]
    assert store["id"][5] == 5 and store["id"][-2] == N - 2 and store["scol"][np.int64(4)] == "s4"
    assert store[["id", "scol"]][2:4].collect() == [(2, "s2"), (3, "s3")] and store[5].collect()[0].id == 5 and store[[]].count() == 0
    assert store.read(columns="id", rows=5).collect() == [(5,)]
    arrays = store.read(asdict=True)
    assert np.allclose(np.sort(arrays["rand"]), np.sort(d["rand"])) and set(arrays) == set(d)
    assert col(store["id"][18:99]) == [18, 19] and store["id"][25:].count() == 0 and store["id"][4:2].count() == 0
    for bad in (lambda: store["id"][[N]], lambda: store["id"][N], lambda: store["id"][-N - 1 : 3]):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: store[["id", "no"]], lambda: store.read("no"), lambda: store["id"][[True, False]], lambda: store["id"][::-1]):
        with pytest.raises(ValueError):
            bad()
    buffer = np.zeros(3, "i8")
    store.read_into("id", buffer, slice(4, 7))
    assert buffer.tolist() == [4, 5, 6]
    for wrong in (np.zeros(2, "i8"), np.zeros(3, "f8"), np.int64(3)):
        with pytest.raises(ValueError):
            store.read_into("id", wrong, slice(4, 7))


def test_empty_table(spark, tmp_path):
    t = Store.create(spark, f"{tmp_path}/e")
    assert t.read() is None and t.nrows == 0
    t.create_table(TableSpec([ColumnSpec("a", "i4"), ColumnSpec("b", "U3")]))
    assert t.read().count() == 0 and (t["a"] > 3).count() == 0 and (t["a"] > 3).minmax() == (None, None)
    t.verify()
    t.vacuum()
    t["a"][:] = 3
    t.resize(2)
    assert t.read().collect() == [(0, ""), (0, "")]


@given(st.integers(-30, 30) | st.none(), st.integers(-30, 60) | st.none(), st.integers(1, 5) | st.none())
def test_slice_bounds(a, b, k):
    s = slice(a, b, k)
    if a is not None and a < -N:
        with pytest.raises(IndexError):
            slice_bounds(s, N)
    else:
        assert list(range(*slice_bounds(s, N))) == list(range(N))[s]


# ---- predicates

OPS = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


@pytest.mark.parametrize("op", OPS)
def test_operators(store, op):
    for v in (-1, 0, 7, N - 1, N):
        assert OPS[op](store["id"], v).ids() == [i for i in range(N) if OPS[op](i, v)]


def leaf():
    return st.tuples(st.sampled_from(list(OPS)), st.integers(-2, 22))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(leaf(), lambda x: st.tuples(st.sampled_from("&|~m"), x, x), max_leaves=5))
def test_algebra(store, tree):
    def plain(t):
        if t[0] in OPS:
            return {i for i in range(N) if OPS[t[0]](i, t[1])}
        a, b = plain(t[1]), plain(t[2])
        return a & b if t[0] in "&m" else a | b if t[0] == "|" else set(range(N)) - a

    def rows(t):
        if t[0] in OPS:
            return OPS[t[0]](store["id"], t[1])
        a, b = rows(t[1]), rows(t[2])
        return {"&": lambda: a & b, "|": lambda: a | b, "~": lambda: ~a, "m": lambda: a.materialized() & b}[t[0]]()

    assert rows(tree).ids() == sorted(plain(tree))


def test_row_sets(spark, store, tmp_path):
    p = store["id"].between(3, 9, "(]")
    assert p.ids() == [4, 5, 6, 7, 8, 9] and p.minmax() == (4, 9) and p.size == 6 and p.array() == p.ids()
    assert store["scol"].match("s3").ids() == [3] and store["id"].match(np.array([5, 1, 5])).ids() == [1, 5]
    assert store["id"].match(range(-20_000, 3)).ids() == [0, 1, 2] and store["id"].between(9, 3).ids() == []
    order = np.argsort(data()["rand"], kind="stable")
    assert col((store["rand"] > -1.0).by_value()) == order.tolist()
    assert "expr" not in repr(p) and RowSet.from_rows(store, [3, -1, 3]).ids() == [3, N - 1]
    assert store[p].count() == 6 and store.where(p).count() == 6 and store.where(F.col("id") > 17).count() == 2
    for bad in (lambda: p & 3, lambda: p | [1], lambda: store["id"].between(1, 2, "[["), lambda: (p & p).by_value()):
        with pytest.raises(ValueError):
            bad()
    other = Store.create_from_array(spark, f"{tmp_path}/o", data())
    with pytest.raises(ValueError):
        p & (other["id"] > 3)
    store["id"][0] = 50
    with pytest.raises(ValueError):  # of an older version
        store[p]


def test_nan_is_greatest(spark, tmp_path):
    t = Store.create_from_array(spark, f"{tmp_path}/n", {"x": np.array([1.0, np.nan, -1.0])})
    assert (t["x"] > 0.0).ids() == [0, 1] and (t["x"] == float("nan")).ids() == [1] and (t["x"] <= 1.0).ids() == [0, 2]


# ---- updates


def test_updates(store):
    want = np.arange(N)
    for rows, new in ((slice(2, 5), [20, 30, 40]), (slice(0, 9, 4), 7), ([9, 3, 6], [90, 33, 60]), ([11, -1], 5), (4, 44), ([1, 1], [8, 9]), (slice(None), list(range(N)))):
        store["id"][rows] = new
        want[rows] = new
        assert values(store, "id") == want.tolist(), rows
    hit = store["id"] > 15
    store["scol"][hit] = "hit"
    assert values(store, "scol")[14:] == ["s14", "s15"] + ["hit"] * 4
    store["id"][store["id"] < 3] = np.array([7, 8, 9])
    assert values(store, "id")[:4] == [7, 8, 9, 3]
    store["rand"] = 2
    assert set(values(store, "rand")) == {2.0}
    store["id"] = np.arange(N) * 2
    assert values(store, "id") == list(range(0, 2 * N, 2))
    store["id"][2:6] = store["id"][6:10]
    assert values(store, "id")[2:6] == [12, 14, 16, 18]
    store.verify()


def test_update_touches_few_files(spark, tmp_path):
    t = Store.create_from_array(spark, f"{tmp_path}/f", {"x": np.arange(10)})
    for _ in range(3):
        t.append({"x": np.arange(10)})
    before = {f["path"] for f in t._state["files"]}
    t["x"][12] = 99
    after = {f["path"] for f in t._state["files"]}
    assert len(before - after) == 1 and values(t, "x")[12] == 99 and t.nrows == 40
    t.verify()
    t.vacuum()
    assert len(t.files.names("data")) == 1 and len(t.files.names("manifest")) == 1
    assert values(t, "x")[10:14] == [0, 1, 99, 3]


def test_update_errors(store):
    for rows, new in ((slice(0, 3), [1, 2]), (slice(15, N + 1), 1), ([N], 1), ([1, 2], [1, 2, 3])):
        with pytest.raises(IndexError):
            store["id"][rows] = new
    with pytest.raises(IndexError):
        store["id"] = [1, 2, 3]
    with pytest.raises(IndexError):
        store["none"] = 1
    version = store.version
    with pytest.raises(ValueError):
        store["id"][0:2] = ["a", "b"]
    with pytest.raises(ValueError):
        store["id"][3] = "x"
    assert store.version == version and values(store, "id") == list(range(N))
    store["scol"][0:2] = [1, 2]
    store["id"][0:2] = [3.9, -3.9]
    assert values(store, "scol")[:2] == ["1", "2"] and values(store, "id")[:2] == [3, -3]


def test_width(spark, tmp_path):
    t = Store.create(spark, f"{tmp_path}/w").create_table(TableSpec([ColumnSpec("s", "U5")]))
    t.append({"s": ["1234567", "é" * 9, ""]})
    assert values(t, "s") == ["12345", "é" * 5, ""]
    t["s"][2] = "abcdefgh"
    assert values(t, "s")[2] == "abcde"


def test_resize(store):
    store.resize(N + 5)
    assert values(store, "id")[N - 1 :] == [N - 1, 0, 0, 0, 0, 0] and values(store, "scol")[-1] == ""
    store["id"].resize(3)
    assert values(store, "id") == [0, 1, 2] and store.nrows == 3
    store.resize(0)
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.resize(-1)


# ---- indexes


def test_index(spark, store):
    with pytest.raises(RuntimeError):
        store["rand"].update_index()
    store["rand"].create_index()
    with pytest.raises(RuntimeError):
        store["rand"].create_index()
    store["rand"].create_index(overwrite=True)
    order = np.argsort(data()["rand"], kind="stable")
    got = store.index_frame("rand").orderBy("rand", "_rowid").collect()
    assert [r._rowid for r in got] == order.tolist() and store["rand"].has_index and store["rand"].index_size_bytes > 0
    assert col((store["rand"] > 0.5).by_value()) == [i for i in order.tolist() if data()["rand"][i] > 0.5]
    store["rand"][0] = 5.0  # kept up to date
    assert store.index_is_fresh("rand") and col((store["rand"] > 1.0).by_value()) == [0]
    path = store._state["indexes"]["rand"]["path"]
    store["id"][0] = 9  # another column: the index stays
    assert store._state["indexes"]["rand"]["path"] == path
    with store.updating(vacuum=True):
        store["rand"][1] = 6.0
        assert not store.index_is_fresh("rand") and (store["rand"] > 5.5).ids() == [1]
    assert store.index_is_fresh("rand") and len(store.files.names("index")) == 1
    with store["rand"]:
        store.append(data(1))
    assert store.index_frame("rand").count() == N + 1
    strict = Store.open(spark, store.path, require_index=True)
    assert (strict["rand"] > 5.5).ids() == [1]
    with pytest.raises(ValueError):
        strict["id"] > 3
    store["rand"].delete_index()
    store.vacuum()
    assert not store["rand"].has_index and store.files.names("index") == []
    with pytest.raises(RuntimeError):
        store.index_frame("rand")


# ---- namespace, metadata, modes


def test_namespace(spark, store):
    store.from_dataframe({"ra": [1.0, 2.0], "dec": [3.0, 4.0]}, "sub1/")
    deep = store.create_table(TableSpec([ColumnSpec("x", "f4")]), "sub1/sub2/sub3/")
    deep.append({"x": [0.5]})
    assert store.sub_table_names == ["sub1/"] and "sub1/sub2/" in store and "./sub1/ra" in store and "sub1/none" not in store
    assert store["sub1"].nrows == 2 and store["sub1/"]["ra"][1] == 2.0 and store["sub1/dec"][0] == 3.0 and store["./sub1/sub2/sub3/x"][0] == 0.5
    assert store["."] is store and store.get("nothing") is None and store.get("id").name == "id"
    assert set(store) == {"id", "rand", "scol", "sub1/"} and len(store) == 4
    for bad in ("nothing", "sub1/zz", "nothing/x"):
        with pytest.raises(IndexError):
            store[bad]
    for bad in ("sub1", "/a/", "/"):
        with pytest.raises(ValueError):
            store.create_table(TableSpec(), bad)
    with pytest.raises(RuntimeError):
        store.create_table(TableSpec([ColumnSpec("y", "f4")]), "sub1/")
    with pytest.raises(TypeError):
        store["sub1"] = 3
    assert "sub1/" in store.tree(True) and "ra" in repr(store) and store.path in repr(store)
    store.list(full=True)
    store.delete_entry("sub1/", yes=True)
    assert "sub1/" not in store
    with pytest.raises(IndexError):
        store.delete_entry("sub1/", yes=True)


def test_meta(spark, store):
    store.create_meta("version", {"numpy": "1.23.5"})
    store.create_meta("list", [3, 4])
    store.create_meta("empty")
    assert store.meta["version"].read() == {"numpy": "1.23.5"} and store.meta["list"].read() == [3, 4] and store.meta["empty"].read() == {}
    store.meta["version"].update({"x": 5})
    assert Store.open(spark, store.path).meta["version"].read() == {"numpy": "1.23.5", "x": 5}
    store.meta["version"].write({"é": 1})
    assert store.meta["version"].read() == {"é": 1} and store.meta_names == ["empty", "list", "version"]
    with pytest.raises(ValueError):
        store.create_meta("list")
    with pytest.raises(TypeError):
        store.meta["list"] = 3
    for bad in (lambda: store.meta["none"], lambda: store.delete_meta("none", yes=True), lambda: store.delete_meta("list"), store.clear):
        with pytest.raises(RuntimeError):
            bad()
    store.delete_meta("list", yes=True)
    assert "list" not in store.meta
    store.delete(yes=True)
    with pytest.raises(RuntimeError):
        Store.open(spark, store.path)


def test_read_only(spark, store):
    store.create_meta("m")
    t = Store.open(spark, store.path)
    for bad in (
        lambda: t.append(data()), lambda: t["id"].__setitem__(0, 1), lambda: t["id"].create_index(), lambda: t.vacuum(), lambda: t.resize(1), lambda: t.delete(yes=True),
        lambda: t.delete_entry("id", yes=True), lambda: t.create_column(ColumnSpec("q", "i4")), lambda: t.meta["m"].write({}), lambda: t.meta["m"].update({}), lambda: t.create_meta("n"),
        lambda: t.updating().__enter__(), lambda: t.create_table(TableSpec(), "a/"), lambda: t.delete_meta("m", yes=True),
    ):
        with pytest.raises(IOError):
            bad()
    with pytest.raises(RuntimeError):
        Store.open(spark, store.path, "w")


def test_two_writers(spark, store):
    other = Store.open(spark, store.path, "r+")
    store["id"][0] = 5
    with pytest.raises(FileExistsError):
        other["id"][1] = 6
    other.reload()
    other["id"][1] = 6
    store.reload(["id"])
    assert values(store, "id")[:2] == [5, 6]
    with pytest.raises(ValueError):
        store.reload(["none"])


# ---- attached folders, ingestion, streams


def test_attached_folder(spark, tmp_path):
    spark.range(1000, numPartitions=6).write.parquet(f"{tmp_path}/t.parquet")
    a = Store.attach(spark, str(tmp_path))
    t = a["t"]
    rows = t.frame().collect()
    assert sorted(r._rowid for r in rows) == list(range(1000)) and t.nrows == 1000 and a.names == ["t/"]
    where = {r._rowid: r.id for r in rows}
    assert t["id"][7] == where[7] and col(t["id"][[9, 2]]) == [where[9], where[2]] and a["t/id"].name == "id"
    assert "t" in a and "u" not in a and "t/zz" not in a and (t["id"] < 5).count() == 5
    with pytest.raises(IOError):
        t["id"][0] = 1
    assert t.frame().filter((t["id"] > 3).expr).count() == 996


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_from_file(spark, tmp_path, fmt):
    writer = spark.createDataFrame([(1, "a"), (2, "b")], "ID int, Name string").write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(f"{tmp_path}/in")
    t = from_file(spark, f"{tmp_path}/out", f"{tmp_path}/in", fmt, lower=True)
    assert set(t.column_names) == {"id", "name"} and sorted(values(t, "name")) == ["a", "b"]
    assert from_file(spark, f"{tmp_path}/out", f"{tmp_path}/in", fmt, lower=True, append=True).nrows == 4


def fits_bytes(rows):
    block = lambda cards: "".join(c.ljust(80) for c in [*cards, "END"]).encode().ljust(2880)
    first = block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"])
    kinds = np.dtype([("ID", ">i8"), ("Ra", ">f8"), ("Name", "S4"), ("Flag", "S1"), ("B", "u1")])
    body = np.array(rows, kinds).tobytes()
    cards = ["XTENSION= 'BINTABLE'           / table", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {kinds.itemsize}", f"NAXIS2  = {len(rows)}", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 5"]
    for k, (name, form) in enumerate((("ID", "1K"), ("Ra", "D"), ("Name", "4A"), ("Flag", "L"), ("B", "B")), 1):
        cards += [f"TTYPE{k}  = '{name}'", f"TFORM{k}  = '{form}'"]
    table = block(cards) if len(cards) < 36 else None
    return first + table + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_from_fits(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits_bytes([(1, 0.5, b"ab", b"T", 255), (2, 1.5, b"cdef", b"F", 0), (-3, 2.5, b"", b"T", 7)]))
    t = from_fits(spark, f"{tmp_path}/out", f"{tmp_path}/a.fits", lower=True)
    assert sorted(map(tuple, t[["id", "ra", "name", "flag", "b"]][:].collect())) == [(-3, 2.5, "", True, 7), (1, 0.5, "ab", True, 255), (2, 1.5, "cdef", False, 0)]


def test_stream(spark, tmp_path):
    t = Store.create(spark, f"{tmp_path}/t").create_table(TableSpec([ColumnSpec("a", "i8")]))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"a": k}))
        stream = spark.readStream.schema("a long").json(f"{tmp_path}/in")
        append_stream(stream, t, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    t.reload()
    assert sorted(values(t, "a")) == [0, 1, 2]


def test_match_lists_alike(spark, tmp_path):
    """A long list of values gives the same set as a short one: order by value, negation with nulls, combinations."""
    rows = [(3,), (None,), (1,), (7,), (None,), (2,)]
    spark.createDataFrame(rows, "v long").coalesce(1).write.parquet(f"{tmp_path}/m/t.parquet")
    table = Store.attach(spark, f"{tmp_path}/m")["t"]
    short, long = table["v"].match([1, 3]), table["v"].match([1, 3, *range(100, 20_000)])
    for f in (lambda m: m, lambda m: ~m, lambda m: ~~m, lambda m: ~(m & (table["v"] > 1)), lambda m: ~m | (table["v"] == 3), lambda m: m.materialized()):
        assert f(long).ids() == f(short).ids()
    assert col(long.by_value()) == col(short.by_value()) == [2, 0] and (~long).ids() == [3, 5]
    assert table[long].count() == 2
    store = Store.create_from_array(spark, f"{tmp_path}/u", data())
    store["rand"][store["id"].match(range(-20_000, 3))] = 9.0
    assert store["rand"][0:3].toPandas()["rand"].tolist() == [9.0] * 3 and (store["rand"] == 9.0).count() == 3


def test_writers_at_once(spark, tmp_path):
    """Of many writers of one manifest, one wins; a document that is replaced is always there."""
    files = Files(spark, f"{tmp_path}/f")
    files.mkdirs("manifest")
    won = []

    def write(k):
        try:
            Files(spark, f"{tmp_path}/f").write_json("manifest/1.json", {"k": k}, replace=False)
            won.append(k)
        except FileExistsError:
            pass

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(24)))
    assert len(won) == 1 and files.read_json("manifest/1.json") == {"k": won[0]}
    files.write_json("doc.json", {"n": -1})
    done = threading.Event()
    seen = []

    def read():
        while not done.is_set():
            seen.append(files.read_json("doc.json")["n"])

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(60):
        files.write_json("doc.json", {"n": n})
    done.set()
    reader.join()
    assert seen == sorted(seen) and files.names() == ["doc.json", "manifest"]


def test_batches_once(spark, tmp_path, monkeypatch):
    """A batch and its number are committed together, so one that runs again after a failure anywhere is there once."""
    t = Store.create(spark, f"{tmp_path}/t").create_table(TableSpec([ColumnSpec("a", "i8")]))
    add, batch = batch_writer(t, "s"), spark.range(3).select(F.col("id").alias("a"))
    plain = Files.write_json

    def broken(self, name, *args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(Files, "write_json", broken)
    with pytest.raises(OSError):
        add(batch, 0)
    monkeypatch.setattr(Files, "write_json", plain)
    for number in (0, 0, 1, 1, 0):
        add(batch, number)
    again = Store.open(spark, t.path)
    assert again.nrows == 6 and again.last_batch("s") == 1 and again.last_batch("other") == -1


def test_verify_reads_files(spark, tmp_path):
    t = Store.create_from_array(spark, f"{tmp_path}/v", data())
    t.verify()
    path = t.filenames[0].removeprefix("file://")
    kept = open(path, "rb").read()
    os.remove(path)
    with pytest.raises(ValueError):
        t.verify()
    with open(path, "wb") as f:
        f.write(kept[: len(kept) // 2])
    with pytest.raises(ValueError):
        t.verify()


def test_update_by_predicate_touches_few_files(spark, tmp_path):
    """Hits at both ends rewrite the files that hold them, not those between."""
    t = Store.create_from_dataframe(spark, f"{tmp_path}/u", spark.range(0, 40_000, numPartitions=8).select("id", (F.col("id") * 0).alias("v")))
    t.append(spark.range(40_000, 80_000, numPartitions=4).select("id", (F.col("id") * 0).alias("v")))
    before = set(t.filenames)
    assert len(before) > 1
    ends = (t["id"] == 3) | (t["id"] == 79_990)
    low = [f for f in t._state["files"] if f["low"] <= 3 <= f["high"] or f["low"] <= 79_990 <= f["high"]]
    t["v"][ends] = 7
    assert len(before - set(t.filenames)) == len(low) and t["v"][3] == 7 and t["v"][79_990] == 7 and (t["v"] == 7).count() == 2
    t["v"][(t["id"] == 5).materialized()] = 8
    assert (t["v"] == 8).ids() == [5]
    t["v"][t["id"] < 0] = 9
    assert (t["v"] == 9).count() == 0


def test_codecs(spark, tmp_path):
    lz4 = {"cname": "lz4", "clevel": 3}
    spec = TableSpec([ColumnSpec("a", "i8", compression=lz4, chunksize="4m"), ColumnSpec("b", "f8")])
    assert spec.write_options() == {"compression": "lz4_raw", "parquet.block.size": str((4 << 20))}
    assert TableSpec([ColumnSpec("a", "i8", compression=True)]).write_options()["parquet.compression.codec.zstd.level"] == "5"
    assert TableSpec([ColumnSpec("a", "i8")]).write_options() == {"compression": "zstd"}
    with pytest.raises(ValueError):
        TableSpec([ColumnSpec("a", "i8", compression={"cname": "none such"})]).write_options()
    t = Store.create(spark, f"{tmp_path}/c").create_table(spec)
    t.append({"a": [1, 2], "b": [0.5, 1.5]})
    assert all("lz4" in f for f in t.filenames) and values(t, "a") == [1, 2]


def test_read_into_rows(store):
    for call, n in ((lambda b: store["id"].read_slice_into(slice(2, 5), b), 3), (lambda b: store["id"].read_rows_into([4, 2], b), 2), (lambda b: store["id"].read_row_into(7, b), 1)):
        buffer = np.zeros(n, "i8")
        call(buffer)
        assert buffer.tolist() in ([2, 3, 4], [4, 2], [7])
        with pytest.raises(ValueError):
            call(np.zeros(n + 1, "i8"))


def test_index_filenames(store):
    assert store["id"].index_filenames == []
    store["id"].create_index()
    assert store["id"].index_filenames and all(f.endswith(".parquet") for f in store["id"].index_filenames)


def fits_table(columns, rows):
    """A file with one table; columns are (name, form, NumPy kind, more cards)."""
    block = lambda cards: "".join(c.ljust(80) for c in [*cards, "END"]).encode()
    pad = lambda b: b.ljust(-(-len(b) // 2880) * 2880, b" ")
    first = pad(block(["SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"]))
    kinds = np.dtype([(n, k) for n, _, k, _ in columns])
    body = np.array(rows, kinds).tobytes()
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {kinds.itemsize}", f"NAXIS2  = {len(rows)}", "PCOUNT  = 0", "GCOUNT  = 1", f"TFIELDS = {len(columns)}"]
    for k, (name, form, _, more) in enumerate(columns, 1):
        cards += [f"TTYPE{k}  = '{name}'", f"TFORM{k}  = '{form}'", *(f"{c}{k}".ljust(8) + f"= {v}" for c, v in more.items())]
    return first + pad(block(cards)) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits_numbers(spark, tmp_path):
    """Unsigned and scaled numbers, missing ones, and arrays; also by URI."""
    big = 1 << 63
    columns = [
        ("u2", "I", ">i2", {"TZERO": 32768}), ("u4", "J", ">i4", {"TZERO": 2147483648}), ("u8", "K", ">i8", {"TZERO": big}), ("i1", "B", "u1", {"TZERO": -128}),
        ("scaled", "I", ">i2", {"TSCAL": 0.5, "TZERO": "1.0D1"}), ("gone", "J", ">i4", {"TNULL": -99}), ("vec", "3E", (">f4", (3,)), {}), ("ints", "2I", (">i2", (2,)), {"TZERO": 32768}),
    ]
    rows = [(40000 - 32768, -1, -1, 0, 4, -99, (1, 2, 3), (-32768, 32767)), (-32768, -(1 << 31), -big, 255, -20, 5, (0, 0.5, -1), (0, 1))]
    (tmp_path / "b.fits").write_bytes(fits_table(columns, rows))
    spark.dataSource.register(FitsSource)
    for path in (f"{tmp_path}/b.fits", f"file://{tmp_path}/b.fits"):
        got = sorted(tuple(r) for r in spark.read.format("fits").load(path).collect())
        assert got == [(0, 0, 0, 127, 0.0, 5, [0.0, 0.5, -1.0], [32768, 32769]), (40000, (1 << 31) - 1, big - 1, -128, 12.0, None, [1.0, 2.0, 3.0], [0, 65535])]
    t = from_fits(spark, f"{tmp_path}/out", f"{tmp_path}/b.fits")
    assert sorted(values(t, "u2")) == [0, 40000] and t["vec"][0] in ([1.0, 2.0, 3.0], [0.0, 0.5, -1.0])


def test_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Files hold as many rows as their bound says, in stretches without gaps; an update of several stretches keeps to them."""
    from lamina.sources import table

    monkeypatch.setattr(table, "FILE_BYTES", 16 * 100)
    t = Store.create_from_dataframe(spark, f"{tmp_path}/s", spark.range(1000, numPartitions=3).select("id", (F.col("id") * 2).alias("v")))
    ranges = lambda: [(f["low"], f["high"]) for f in sorted(t._state["files"], key=lambda f: f["low"])]
    hundreds = [(a, a + 99) for a in range(0, 1000, 100)]
    assert ranges() == hundreds
    before = {f["path"] for f in t._state["files"]}
    t["v"][(t["id"] < 5) | t["id"].between(290, 310) | (t["id"] == 999)] = -1
    assert ranges() == hundreds and len(before & {f["path"] for f in t._state["files"]}) == 6
    t["v"][[950, 7]] = [-7, -8]
    want = {i: -1 if i < 5 or 290 <= i <= 310 or i == 999 else {950: -7, 7: -8}.get(i, 2 * i) for i in range(1000)}
    assert {r["id"]: r["v"] for r in t.read().collect()} == want and ranges() == hundreds
    t.append(spark.range(150).select("id", F.col("id").alias("v")))
    t.append(spark.range(0).select("id", F.col("id").alias("v")))
    assert ranges() == [*hundreds, (1000, 1099), (1100, 1149)]
    t.resize(1120)
    t.verify()
    t.vacuum()
    assert ranges() == [*hundreds, (1000, 1099), (1100, 1119)]
    t.create_index("v")
    assert len(t.index_filenames("v")) > 5 and t["v"].between(-8, -7).count() == 2
    monkeypatch.setattr(table, "MOST_FILES", 4)
    t["v"][:] = 0
    assert ranges() == [(a, a + 279) for a in range(0, 1120, 280)] and t.read().filter("v != 0").count() == 0
    t.verify()
