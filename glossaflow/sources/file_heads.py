"""A data source of files with their first bytes, and what texts are encoded in: tasks list folders and read files."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 64
#: Texts are read in blocks of so many bytes, so a task holds one block whatever the size of a file.
BLOCK_BYTES = 1 << 20
#: Levels of folders that are listed to deal the rest out; what lies deeper is walked by one task.
DEALT_LEVELS = 2


def _system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, place in it, and what stands before the place in full names."""
    url = path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"
    system, place = pafs.FileSystem.from_uri(url)
    return system, place, url.removesuffix(place)


def _named(head: str, place: str) -> str:
    """A full name as Spark's own file sources write it."""
    return f"file:{place}" if head.startswith("file:") else head + place


def _place(head: str, path: str) -> str:
    """The place of a full name, as ``_named`` makes it."""
    return path.removeprefix("file:" if head.startswith("file:") else head)


def _children(system: pafs.FileSystem, place: str) -> list[pafs.FileInfo]:
    """What lies directly in a folder; names starting with _ or . are hidden."""
    found = system.get_file_info(pafs.FileSelector(place))
    return sorted((e for e in found if not e.base_name.startswith(("_", "."))), key=lambda e: e.path)


@dataclass
class _Folder(InputPartition):
    place: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("headbytes", HEAD_BYTES))
        self.levels = int(options.get("levels", DEALT_LEVELS))

    def partitions(self) -> list[_Folder]:
        system, place, _ = _system(self.path)
        parts, level = [], [place]
        for _ in range(self.levels):
            parts += [_Folder(p, False) for p in level]
            level = [e.path for p in level for e in _children(system, p) if e.type == pafs.FileType.Directory]
        return parts + [_Folder(p, True) for p in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        system, _, head = _system(self.path)
        folders = [partition.place]
        while folders:
            for e in _children(system, folders.pop()):
                if e.type == pafs.FileType.Directory:
                    if partition.deep:
                        folders.append(e.path)
                    continue
                first = b""
                if e.size and self.bytes:
                    with system.open_input_file(e.path) as file:
                        first = file.read_at(min(self.bytes, e.size), 0)
                yield _named(head, e.path), e.mtime, e.size or 0, first


class FileHeads(DataSource):
    """``path`` is a folder; ``headbytes`` says how much of each file is read, ``levels`` how folders are dealt out."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, head binary"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_heads(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(path, modificationTime, length, head) of all files of a folder and its folders, empty ones too."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("headbytes", head_bytes).load(path)


def _encoding(system: pafs.FileSystem, place: str, names: tuple[str, ...]) -> str | None:
    """The first of the encodings that a file can be decoded by, from its first byte to its last; else null."""
    for name in names:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with system.open_input_stream(place) as file:
                while block := file.read(BLOCK_BYTES):
                    decoder.decode(block)
            decoder.decode(b"", final=True)
            return name
        except UnicodeDecodeError:
            continue
    return None


def with_encoding(files: DataFrame, folder: str, is_text: Column, names: tuple[str, ...]) -> DataFrame:
    """The files of a folder with their ``encoding``, null where ``is_text`` does not hold or no encoding fits.

    Texts are read whole and once, unless an encoding fails; files are dealt over the tasks by their path.
    """
    session = files.sparkSession
    # So many tasks at least, as the work on a file is far larger than its row.
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, head = _system(folder)
        for batch in batches:
            paths, asked = batch.column("path").to_pylist(), batch.column("_asked").to_pylist()
            found = [_encoding(system, _place(head, p), names) if a else None for p, a in zip(paths, asked)]
            yield batch.drop_columns(["_asked"]).append_column("encoding", pa.array(found, pa.string()))

    asked = files.withColumn("_asked", F.coalesce(is_text, F.lit(False))).repartition(tasks, "path")
    return asked.mapInArrow(read, T.StructType([*files.schema, T.StructField("encoding", T.StringType())]))
