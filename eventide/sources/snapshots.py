"""Versions of a table: a write never touches what readers have.

Every write goes to a folder of its own under the table. Which folders, or which partitions of them,
make up the table is said by one small file, ``_current``, that is replaced last and in one step. So
a run that ends anywhere before leaves the old version in place, a reader that has looked at the file
once keeps reading one version, and replacing some partitions copies none of the others.

One writer per table at a time: a second one that started from the same version is refused when it
commits. Folders that no kept version names are removed by `expire`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import SparkSession

POINTER = "_current"
_PREFIX = "v="

# Folder → the partition folders in it that are part of the table, all of it for None.
Folders = Mapping[str, list[str] | None]


class Snapshot(NamedTuple):
    """A version of a table; ``history`` are the versions before it that are still kept, and ``note``
    is whatever its writer has to remember, such as what it was made from."""

    id: int
    folders: dict[str, list[str] | None]
    history: list[tuple[int, dict[str, list[str] | None]]] = []
    note: dict = {}

    def paths(self, table: str) -> list[str]:
        """What to read."""
        root = table.rstrip("/")
        found = []
        for folder, parts in self.folders.items():
            own = f"{root}/{folder}" if folder else root
            found += [own] if parts is None else [f"{own}/{part}" for part in parts]
        return found


class StaleWrite(RuntimeError):
    """Another write was committed since this one began."""


class _Files:
    """The file system of a table, by way of Spark's own configuration."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = table.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        try:
            stream = self._fs.open(path)
        except Exception as error:
            if "FileNotFoundException" in str(error):
                return None
            raise
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over: readers see the old text or the new one."""
        fresh = self._path(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf)
        context.rename(fresh, self._path(name), how)

    def folders(self, name: str = "") -> list[str]:
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path) if s.isDirectory())

    def remove_if_empty(self) -> None:
        if not self._fs.listStatus(self._path("")):
            self._fs.delete(self._path(""), False)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file, there in full or not at all."""
    _Files(spark, folder).replace(name, text)


def current(spark: SparkSession, table: str) -> Snapshot | None:
    """The version readers see; None for a table without versions."""
    text = _Files(spark, table).read(POINTER)
    if text is None:
        return None
    found = json.loads(text)
    return Snapshot(found["id"], found["folders"], [(i, f) for i, f in found["history"]], found.get("note", {}))


def fresh_folder(based_on: Snapshot | None) -> str:
    """Name of a folder for the version after ``based_on``; no two writes share one."""
    number = based_on.id + 1 if based_on else 1
    return f"{_PREFIX}{number:09d}-{uuid.uuid4().hex[:8]}"


def partitions(spark: SparkSession, table: str, folder: str) -> set[str]:
    """Partition folders in one folder of a table."""
    return set(_Files(spark, table).folders(folder))


def restricted(spark: SparkSession, table: str, version: Snapshot | None, parts: set[str]) -> Snapshot | None:
    """A version with some of its partitions alone: the others are not even listed."""
    if version is None:
        return None
    files = _Files(spark, table)
    kept = {folder: sorted(parts & set(files.folders(folder) if own is None else own))
            for folder, own in version.folders.items()}
    return version._replace(folders={folder: own for folder, own in kept.items() if own})


def remaining(spark: SparkSession, table: str, based_on: Snapshot | None, written: str,
              also: Iterable[str] = ()) -> Folders:
    """What stays of a table when the partitions in the folder ``written`` take the place of theirs.

    ``also`` names partitions that go, whether or not any row of them was written. The partitions of
    a table that has no versions yet are taken over as they are.
    """
    files = _Files(spark, table)
    gone = {*files.folders(written), *also}
    before: Folders = based_on.folders if based_on else {"": [
        f for f in files.folders() if "=" in f and not f.startswith(_PREFIX)]}
    stays: dict[str, list[str] | None] = {}
    for folder, parts in before.items():
        every = files.folders(folder) if parts is None else parts
        kept = [p for p in every if p not in gone]
        if kept:
            stays[folder] = None if parts is None and len(kept) == len(every) else kept
    return stays


def commit(spark: SparkSession, table: str, based_on: Snapshot | None, folders: Folders,
           keep: int = 2, note: Mapping | None = None) -> Snapshot:
    """Make ``folders`` the table. ``keep`` versions, this one included, stay readable."""
    now = current(spark, table)
    if (now and now.id) != (based_on and based_on.id):
        raise StaleWrite(f"{table}: version {now and now.id} was written meanwhile")
    history = [(based_on.id, based_on.folders), *based_on.history][:keep - 1] if based_on else []
    made = Snapshot(based_on.id + 1 if based_on else 1, dict(folders), history, dict(note or {}))
    _Files(spark, table).replace(POINTER, json.dumps(made._asdict()))
    return made


def drop_folder(spark: SparkSession, table: str, folder: str) -> None:
    """Remove a folder, and the table's own if there is nothing else in it."""
    files = _Files(spark, table)
    files.remove(folder)
    files.remove_if_empty()


def expire(spark: SparkSession, table: str) -> list[str]:
    """Remove what no kept version names, and return it: old partitions, and writes that never ended.

    A write that is still going on is numbered after the current version and left alone.
    """
    now = current(spark, table)
    if now is None:
        return []
    files = _Files(spark, table)
    versions = [now.folders, *(folders for _, folders in now.history)]
    removed = []
    for folder in files.folders():
        if not folder.startswith(_PREFIX) or int(folder[len(_PREFIX):].split("-")[0]) > now.id:
            continue
        named = [v[folder] for v in versions if folder in v]
        if not named:
            gone: Iterable[str] = [folder]
        elif any(parts is None for parts in named):
            continue
        else:
            used = {p for parts in named for p in parts}
            gone = [f"{folder}/{p}" for p in files.folders(folder) if p not in used]
        for name in gone:
            files.remove(name)
            removed.append(name)
    return removed
