"""Snapshots of a table that readers see whole or not at all.

A save writes a folder of its own under ``versions`` and then publishes it: a
small file named by the next number is created under ``published`` and names
the folder.  Readers take the file of the largest number that is whole, so a
save that fails or is killed at any time leaves what was published before, and
a reader meets one version however long it reads.  Two savers cannot create
the same number; the second takes the next one.  A publication clears versions
beyond the last ``keep`` published ones, and folders that were never published
once they are older than ``abandoned`` seconds.

All steps go through Hadoop's file system layer, so any folder that Spark can
write to will do.  Edge cases: a folder without a published version raises
NoSnapshot; a half-written publication is passed over; an empty table is a
version like any other; nulls, ties and repeated rows are kept as they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEEP, ABANDONED = 2, 24 * 3600


class NoSnapshot(FileNotFoundError):
    """Nothing has been published in the folder."""


class _Folder:
    """A folder on any of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self, name: str) -> Iterator[tuple[str, int]]:
        """Names and times of change, in seconds."""
        if self.fs.exists(self._at(name)):
            for s in self.fs.listStatus(self._at(name)):
                yield s.getPath().getName(), s.getModificationTime() // 1000

    def create(self, name: str, text: str) -> bool:
        """Creates a file that must not exist; whether it did."""
        try:
            out = self.fs.create(self._at(name), False)
        except Exception:
            if self.fs.exists(self._at(name)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def text(self, name: str) -> str:
        data = self.fs.open(self._at(name))
        try:
            return bytes(data.readAllBytes()).decode("utf-8", "replace")
        finally:
            data.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _published(folder: _Folder) -> list[tuple[int, str]]:
    """(number, version) of whole publications, the last first."""
    out = []
    for name in sorted((n for n, _ in folder.files("published") if n.isdigit()), reverse=True):
        try:
            out.append((int(name), json.loads(folder.text(f"published/{name}"))["version"]))
        except (ValueError, KeyError):  # being written, or cut off
            continue
    return out


def save(df: DataFrame, path: str, keep: int = KEEP, abandoned: int = ABANDONED, form: str = "parquet") -> int:
    """Publishes df as the newest version; returns its number."""
    folder, version = _Folder(df.sparkSession, path), uuid.uuid4().hex
    try:
        df.write.format(form).save(f"{folder.path}/versions/{version}")
    except Exception:
        folder.delete(f"versions/{version}")
        raise
    said = json.dumps({"version": version, "form": form, "schema": df.schema.jsonValue()})
    number = 1 + max((int(n) for n, _ in folder.files("published") if n.isdigit()), default=0)
    while not folder.create(f"published/{number:020d}", said):
        number += 1
    _clear(folder, keep, abandoned)
    return number


def _clear(folder: _Folder, keep: int, abandoned: int) -> None:
    old = _published(folder)[keep:]
    for number, version in old:
        folder.delete(f"versions/{version}")
        folder.delete(f"published/{number:020d}")
    named, now = {v for _, v in _published(folder)}, time.time()
    for version, changed in list(folder.files("versions")):
        if version not in named and now - changed > abandoned:
            folder.delete(f"versions/{version}")


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, the newest first."""
    return [n for n, _ in _published(_Folder(spark, path))]


def load(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version, or that of a number."""
    from pyspark.sql.types import StructType

    folder = _Folder(spark, path)
    found = next((n for n, _ in _published(folder) if number in (None, n)), None)
    if found is None:
        raise NoSnapshot(f"{path}: no version {'' if number is None else number}")
    said = json.loads(folder.text(f"published/{found:020d}"))
    return spark.read.format(said["form"]).schema(StructType.fromJson(said["schema"])).load(f"{folder.path}/versions/{said['version']}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a snapshot with all its versions; nothing happens if there is none."""
    _Folder(spark, path).delete("")
