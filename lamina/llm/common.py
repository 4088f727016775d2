"""Helpers shared by the operators: shared storage, sized joins, word rules and span digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class and as characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table called ``name`` under ``sf_dir``; any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the session's own or, if driver and executors are one machine (tests), a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
    return context.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Whether Spark removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: what they write or collect is all that is read of them."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a reread, lets later steps
    prune columns, and frees the shuffle files behind it. The schema is given, so that an empty result reads back as empty.
    """
    return _write(df, shared_path(df.sparkSession, name))


class Scratch:
    """Tables that one operator needs while it works; ``remove`` frees them once its result is written elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._path = spark, shared_path(spark, name)
        self._kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As materialize, below the scratch folder."""
        path = f"{self._path}/{name}-{uuid.uuid4().hex}"
        out = _write(df, path)
        self._kept.append((out, path))
        return out

    def mark(self) -> int:
        """How many tables there are, for ``free_since``."""
        return len(self._kept)

    def free(self, *tables: DataFrame) -> None:
        """Remove tables that nothing to come reads."""
        for _, path in [x for x in self._kept if any(x[0] is t for t in tables)]:
            self._delete(path)
        self._kept = [x for x in self._kept if not any(x[0] is t for t in tables)]

    def free_since(self, mark: int, *still: DataFrame) -> None:
        """Remove the tables kept after a mark, but for those that are needed still."""
        self.free(*[t for t, _ in self._kept[mark:] if not any(t is s for s in still)])

    def remove(self) -> None:
        self._delete(self._path)

    def _delete(self, path: str) -> None:
        hadoop = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def lookup_join(left: DataFrame, table: DataFrame, keys: list[str], how: str = "left", limit: int = 200_000, salts: int = 32) -> DataFrame:
    """Join ``left`` with a materialised ``table`` that has unique ``keys``, safe against hot keys on the left.

    ``table`` is counted first. Up to ``limit`` rows it is broadcast. Beyond that
    every row of it is repeated under ``salts`` salts and the left rows are dealt
    over them, so that one key's rows meet in ``salts`` tasks instead of one.
    """
    if table.count() <= limit:
        return left.join(F.broadcast(table), keys, how)
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(spread, [*keys, "__salt"], how).drop("__salt")


def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, from an array of structs (start, rank, kind, end)."""
    ordered = F.sort_array(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
