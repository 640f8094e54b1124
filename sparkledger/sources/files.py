"""Paths on any file system that Spark reaches, with the few operations of pathlib that published data needs."""

from __future__ import annotations

import shutil
from pathlib import Path
from typing import Any, Self

from pyspark.sql import SparkSession


class HadoopPath:
    """A path on a Hadoop file system."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self._spark, self._uri = spark, uri if uri.endswith("://") else uri.rstrip("/")

    def __str__(self) -> str:
        return self._uri

    def __repr__(self) -> str:
        return f"HadoopPath({self._uri!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, HadoopPath) and self._uri == other._uri

    def __hash__(self) -> int:
        return hash(self._uri)

    def __truediv__(self, part: str) -> Self:
        return type(self)(self._spark, f"{self._uri}/{part}")

    @property
    def name(self) -> str:
        return self._uri.rpartition("/")[2]

    @property
    def parent(self) -> Self:
        return type(self)(self._spark, self._uri.rpartition("/")[0])

    def with_name(self, name: str) -> Self:
        return self.parent / name

    def resolve(self) -> Self:
        return self

    @property
    def _jvm(self) -> Any:
        return self._spark.sparkContext._jvm

    @property
    def _path(self) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self._uri)

    @property
    def _conf(self) -> Any:
        return self._spark.sparkContext._jsc.hadoopConfiguration()

    @property
    def _fs(self) -> Any:
        return self._path.getFileSystem(self._conf)

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def is_dir(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isDirectory()

    def is_file(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isFile()

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:  # noqa: ARG002
        self._fs.mkdirs(self._path)

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        stream = self._fs.create(self._path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def unlink(self, missing_ok: bool = False) -> None:
        if not self._fs.delete(self._path, False) and not missing_ok:
            raise FileNotFoundError(self._uri)

    def rename(self, target: HadoopPath) -> None:
        if target.exists() or not self._fs.rename(self._path, target._path):
            raise OSError(f"{self} can't be renamed to {target}")

    def replace(self, target: HadoopPath) -> None:
        """Take the place of a file in one step, where the file system can."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path.toUri(), self._conf).rename(self._path, target._path, how)

    def remove_tree(self) -> None:
        self._fs.delete(self._path, True)


SharedPath = Path | HadoopPath


def place(root: str | SharedPath) -> SharedPath:
    return root if isinstance(root, (Path, HadoopPath)) else Path(root)


def shared(spark: SparkSession, root: str | SharedPath) -> SharedPath:
    """The root as Spark sees it: a local path only if it names no file system and Spark's own is the local one."""
    if isinstance(root, HadoopPath):
        return root
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    local = str(conf.get("fs.defaultFS", "file:///")).startswith("file:")
    return Path(root) if local and ":/" not in str(root) else HadoopPath(spark, str(root))


def remove(p: SharedPath) -> None:
    """Remove a tree; nothing happens if it isn't there."""
    if isinstance(p, HadoopPath):
        p.remove_tree()
    else:
        shutil.rmtree(p, ignore_errors=True)
