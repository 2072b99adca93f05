"""A sink that writes named files: one file per name, in folders, without a folder per key.

Rows are (name, content); rows of one name that follow each other make one file. A task writes
to a folder of its own; when all tasks are done, the driver moves their files to their names.
A task that is repeated, or a job that fails, therefore leaves nothing behind, and readers never
see half a file. What passes through the driver is one folder name per task.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from locengine.sources.arrow import explode_rows

FORMAT = "locengine_files"
FOLDERS = 256  # that are walked in tasks, if there are as many
DONE = "_SUCCESS"
NAMES = "names"


@dataclass
class Written(WriterCommitMessage):
    folder: str


def _clean(name: str | None) -> str:
    """A name with folders, within the target folder."""
    parts = [p for p in (name or "").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or parts[0].startswith("_") or "\n" in parts[-1]:
        raise ValueError(f"not a file name: {name!r}")
    return "/".join(parts)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.stage = f"_temporary-{uuid.uuid4().hex}"

    def _open(self) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._open()
        task = TaskContext.get()
        folder = f"{root}/{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        current, out, number = None, None, 0
        with system.open_output_stream(f"{folder}/{NAMES}") as names:
            for batch in iterator:
                for name, content in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                    if out is None or name != current:
                        if out is not None:
                            out.close()
                        current = name
                        names.write(f"{_clean(name)}\n".encode())
                        out = system.open_output_stream(f"{folder}/{number}")
                        number += 1
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
            if out is not None:
                out.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        made: set[str] = set()

        def move(job: tuple[str, str]) -> None:
            staged, name = job
            target = f"{root}/{name}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            if not self.overwrite and system.get_file_info(target).type != pafs.FileType.NotFound:
                raise FileExistsError(target)
            system.move(staged, target)

        def jobs() -> Iterator[tuple[str, str]]:
            for m in messages:
                if m is not None:
                    with system.open_input_file(f"{m.folder}/{NAMES}") as names:
                        for i, line in enumerate(io.TextIOWrapper(names, "utf-8", newline="\n")):
                            yield f"{m.folder}/{i}", line.rstrip("\n")

        work = jobs()
        with ThreadPoolExecutor(16) as pool:
            while some := list(islice(work, 4096)):
                list(pool.map(move, some))
        self.abort(messages)  # what is left is names and empty folders
        with system.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        if system.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class NamedFiles(DataSource):
    """``df.write.format(FORMAT).mode("append").save(path)``, of a table (name, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def relative_path(path: Column) -> Column:
    """A path or address without its scheme and leading slashes."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "")


def write_named(rows: DataFrame, path: str, overwrite: bool = False, ordered: bool = False) -> None:
    """Write a table (name, content) as files below ``path``.

    Every name must stand in one row, or, with ``ordered``, in rows that follow each other in
    one partition. A name that stands elsewhere again is an error, before anything is written.
    """
    if not ordered:
        twice = rows.groupBy("name").count().filter("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"names that stand more than once: {[r['name'] for r in twice]}")
    rows.sparkSession.dataSource.register(NamedFiles)
    mode = "overwrite" if overwrite else "append"
    rows.select("name", "content").write.format(FORMAT).mode(mode).save(path)


def _entries(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What a folder holds, but hidden files and folders, as Spark's readers see it."""
    found = system.get_file_info(pafs.FileSelector(folder))
    return [i for i in found if not i.base_name.startswith(("_", "."))]


def read_named(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(name, content) of the files below ``path`` whose names have this ending.

    The driver goes down level by level until there are folders enough for all tasks; these walk
    them and read the files. Spark's file index asks a local file system for the owner and the
    rights of each file by a process of its own, which takes longer than all else.
    """
    system, root = pafs.FileSystem.from_uri(path)
    root = root.rstrip("/")
    walked, level = [], [root]  # folders of which only the own files are left, and whole ones
    while level and len(level) < FOLDERS:
        walked += level
        inner = [i.path for f in level for i in _entries(system, f) if i.type == pafs.FileType.Directory]
        level = inner
    rows = [(f, False) for f in walked] + [(f, True) for f in level]

    def files(row: dict) -> Iterator[dict]:
        own, _ = pafs.FileSystem.from_uri(path)
        folders = [row["folder"]]
        while folders:
            for i in _entries(own, folders.pop()):
                if i.type == pafs.FileType.Directory:
                    folders += [i.path] if row["whole"] else []
                elif i.base_name.endswith(ending):
                    with own.open_input_file(i.path) as file:
                        yield {"name": posixpath.relpath(i.path, root), "content": file.read()}

    tasks = max(spark.sparkContext.defaultParallelism, min(len(rows), FOLDERS))
    folders = spark.createDataFrame(rows, "folder string, whole boolean").repartition(tasks)
    return explode_rows(folders, files, StructType().add("name", "string").add("content", "binary"))
