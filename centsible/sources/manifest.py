"""Which folders make up the tables of a store, version by version.

A table is a set of parts, each a folder that is written once and never changed. A version of the manifest names the
parts of all tables, so everything one batch wrote becomes visible together. Readers read exactly the folders named:
what a failed attempt left behind is not seen, and a named folder that is gone fails the read. One writer at a time;
a second one fails because its version exists already.

The versions before the last ``keep`` are removed, and with them the parts that no kept version names. A reader
can so finish on the version that it began with while that many commits follow.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import SparkSession

PART_SCHEMA = "table string, path string, level int, first bigint, last bigint, key string"


class Part(NamedTuple):
    """A folder below the root, how often its rows were merged, the batches they came with, and what they share (a
    month, an hour), if anything."""

    table: str
    path: str
    level: int
    first: int
    last: int
    key: str | None = None


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    files, place = _file_system(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    files, place = _file_system(spark, path)
    return files.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def renamed(spark: SparkSession, path: str, to: str) -> None:
    files, place = _file_system(spark, path)
    if not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not become {to}")


@dataclass(frozen=True)
class Manifest:
    spark: SparkSession
    root: str
    keep: int = 16

    def _path(self, version: int) -> str:
        return f"{self.root}/manifest/version={version}"

    def _complete(self, version: int) -> bool:
        # its only file appears by a rename when the write is committed
        return any(name.startswith("part-") for name in names_in(self.spark, self._path(version)))

    def versions(self) -> list[int]:
        names = names_in(self.spark, f"{self.root}/manifest")
        return sorted(int(name.split("=")[1]) for name in names if name.startswith("version="))

    def _parts(self, versions: Iterable[int]) -> list[Part]:
        paths = [self._path(version) for version in versions]
        if not paths:
            return []
        return [Part(*row) for row in self.spark.read.schema(PART_SCHEMA).parquet(*paths).collect()]

    def newest(self) -> tuple[int, list[Part]]:
        """Number and parts of the newest complete version; (0, none) before the first."""
        for version in reversed(self.versions()):
            if self._complete(version):
                return version, self._parts([version])
        return 0, []

    def commit(self, add: Iterable[Part], drop: Iterable[Part] = ()) -> None:
        """A new version with some parts more and some less. A part of the same table, batch and key that was not
        merged yet is an earlier attempt at the same batch, and goes too."""
        version, parts = self.newest()
        add, gone = list(add), set(drop)
        if missing := gone - set(parts):
            raise ValueError(f"no longer in the manifest: {sorted(p.path for p in missing)}")
        again = {(p.table, p.first, p.last, p.key) for p in add if p.level == 0}
        kept = [p for p in parts if p not in gone and not (p.level == 0 and (p.table, p.first, p.last, p.key) in again)]
        new = version + 1
        rows = self.spark.createDataFrame(kept + add, PART_SCHEMA).coalesce(1)
        # a folder without a file is what a failed commit left
        unfinished = new in self.versions() and not self._complete(new)
        rows.write.mode("overwrite" if unfinished else "error").parquet(self._path(new))
        self._forget(kept + add)

    def _forget(self, current: list[Part]) -> None:
        versions = self.versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        if not old:
            return
        named = {part.path for part in self._parts(v for v in kept if self._complete(v))} | {part.path for part in current}
        for path in {part.path for part in self._parts(v for v in old if self._complete(v))} - named:
            remove(self.spark, f"{self.root}/{path}")
        for version in old:
            remove(self.spark, self._path(version))
