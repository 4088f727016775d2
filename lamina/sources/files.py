"""Small files and folders through Spark's file systems, so that a store can be wherever Spark can write."""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: File systems where a rename is no single step, and a file is seen whole once it is closed.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos", "cosn", "obs", "swift"}


class Files:
    """File operations below one path."""

    def __init__(self, spark: SparkSession, root: str):
        root = os.path.expandvars(root)
        if "://" not in root and not root.startswith("file:"):
            root = "file://" + os.path.abspath(root)
        self.root = root.rstrip("/")
        self._jvm, self._gateway, self._conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._local = self._path("").toUri().getPath() if self.root.startswith("file:") else None

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def read_json(self, name: str) -> object:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, name: str, value: object, replace: bool = True) -> None:
        """Write a document so that readers see the old or the new and never neither. Without ``replace`` an existing file is an error, for one of two writers at once too.

        On mounted folders by a link or a move of the system's own; on other file
        systems by a rename that is one step there; on object stores, which show a
        file when it is closed, by writing it in place.
        """
        text = json.dumps(value, indent=1).encode()
        if self._local is not None:
            self._write_local(name, text, replace)
            return
        hadoop = self._jvm.org.apache.hadoop.fs
        if self._fs.getScheme() in OBJECT_STORES:
            try:
                self._put(name, text, replace)
            except Py4JJavaError as e:
                if replace or not self.exists(name):
                    raise
                raise FileExistsError(self.at(name)) from e
            return
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(beside, text, False)
        kinds = getattr(hadoop, "Options$Rename")
        options = self._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE if replace else kinds.NONE
        try:
            hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(beside), self._path(name), options)
        except Py4JJavaError as e:
            self.delete(beside)
            if replace or not self.exists(name):
                raise
            raise FileExistsError(self.at(name)) from e

    def write_bytes(self, name: str, data: bytes) -> None:
        """Write a new file."""
        self._put(name, data, False)

    def _put(self, name: str, data: bytes, replace: bool) -> None:
        stream = self._fs.create(self._path(name), replace)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def _write_local(self, name: str, data: bytes, replace: bool) -> None:
        path = os.path.join(self._local, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(beside, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        # a checksum that Hadoop wrote for an earlier file would not fit
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
        if replace:
            os.replace(beside, path)
            return
        try:
            os.link(beside, path)
        finally:
            os.remove(beside)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()
