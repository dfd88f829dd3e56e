"""Writes in two phases: everything is staged beside the target, one step makes it count.

Staged folders lie below ``_staged``, which Spark's readers pass over. What a write replaces
is untouched until the write's list of folders exists; that file is created by one rename.
From then on the write is complete: moving the listed folders into place can be interrupted
and is taken up again by the next reader or writer (``finish``). A target has one writer at
a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

STAGED = "_staged"
_COMMIT = ".commit"


class Files:
    """The few operations on folders that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._copy = jvm.org.apache.hadoop.fs.FileUtil.copy
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str):
        # The second argument is taken as it is; a percent sign is no escape there.
        return self._path(self._path(self.root), name) if name else self._path(self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.root}: cannot rename {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        self._copy(self.fs, self.at(old), self.fs, self.at(new), False, self._conf)

    def write_text(self, name: str, text: str) -> None:
        """The file appears whole or not at all."""
        part = f"{name}.part"
        out = self.fs.create(self.at(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(part, name)

    def read_text(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def new_stage() -> str:
    """The name of a new staged folder, relative to its target."""
    return f"{STAGED}/{uuid.uuid4().hex}"


def commit(files: Files, stage: str, folders: list[str], dropped: list[str] | None = None) -> None:
    """Make the staged ``folders`` replace those of the same names, and drop ``dropped``."""
    files.write_text(stage + _COMMIT, json.dumps({"folders": folders, "dropped": dropped or []}))
    _move(files, stage)


def _move(files: Files, stage: str) -> None:
    told = json.loads(files.read_text(stage + _COMMIT))
    for folder in told["dropped"]:
        files.delete(folder)
    for folder in told["folders"]:
        # A folder that is staged no more was moved before an interruption.
        if files.exists(f"{stage}/{folder}"):
            files.delete(folder)
            files.rename(f"{stage}/{folder}", folder)
    files.delete(stage)
    files.delete(stage + _COMMIT)


def finish(spark: SparkSession, target: str, writing: bool = False) -> None:
    """Complete committed writes; a writer also drops what failed writes have left."""
    files = Files(spark, target)
    names = files.names(STAGED)
    for name in names:
        if name.endswith(_COMMIT):
            _move(files, f"{STAGED}/{name.removesuffix(_COMMIT)}")
    if writing:
        for name in files.names(STAGED):
            files.delete(f"{STAGED}/{name}")
