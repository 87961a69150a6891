"""Files listed and read by tasks: no list of names passes through the driver.

Folders are spread over tasks, each of which walks the folders below its own. What a task finds is dealt over
tasks by name, and read there in batches of bounded size. Files without bytes are files like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "folder string, path string, size long"
READ_BYTES = 16 << 20
LISTED_ROWS = 10_000


def _open(uri: str) -> tuple[FileSystem, str]:
    """The store of a folder, and the folder's place in it; a plain path is a local one."""
    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _folders(uri: str, enough: int) -> tuple[list[tuple[str, bool]], str]:
    """At least ``enough`` folders (if there are so many) that cover all files, each with whether its own
    subfolders are still to be walked, and the given folder as the store names it.

    Whole levels are listed, so what the driver holds is about ``enough`` folders and those of one level.
    """
    store, root = _open(uri)
    done: list[tuple[str, bool]] = []
    level = [root]
    while level and len(done) + len(level) < enough:
        done += [(folder, False) for folder in level]
        level = [x.path for folder in level for x in store.get_file_info(FileSelector(folder)) if x.type == FileType.Directory]
    return done + [(folder, True) for folder in level], root


def _walker(uri: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(uri)
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns)):
                waiting, rows = [folder], []
                while waiting:
                    at = waiting.pop()
                    for x in store.get_file_info(FileSelector(at)):
                        if x.type == FileType.Directory and deep:
                            waiting.append(x.path)
                        elif x.type == FileType.File:
                            rows.append((at, x.path, x.size))
                    if len(rows) >= LISTED_ROWS or not waiting:
                        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["folder", "path", "size"])
                        rows = []

    return walk


def list_files(spark: SparkSession, uri: str, recursive: bool = True) -> DataFrame:
    """(folder, path, size) of every file below a folder."""
    tasks = spark.sparkContext.defaultParallelism
    folders, root = _folders(uri, 4 * tasks)
    if not recursive:
        folders = [(root, False)]
    given = spark.createDataFrame(folders, "folder string, deep boolean").repartition(min(len(folders), 4 * tasks))
    return given.mapInArrow(_walker(uri), LISTED)


def _reader(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(uri)
        paths, contents, held = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    paths.append(path)
                    contents.append(source.read())
                held += len(contents[-1])
                if held >= READ_BYTES or len(paths) >= LISTED_ROWS:
                    yield rows()
                    paths, contents, held = [], [], 0
        yield rows()

    return read


def read_files(listed: DataFrame, uri: str, partitions: int | None = None) -> DataFrame:
    """(path, content as bytes) of listed files, dealt over tasks by their names, each file read once."""
    number = partitions or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path").repartition(number, "path").mapInArrow(_reader(uri), "path string, content binary")


def _writer(uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(uri)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1)):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    return write


def write_files(files: DataFrame, uri: str) -> int:
    """Write (name, bytes) as files below a shared folder, from the tasks; a task that is run again writes the same."""
    return files.mapInArrow(_writer(uri), "n long").agg(F.sum("n")).first()[0] or 0
