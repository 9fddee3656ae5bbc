"""Names, sizes, times and MD5 digests of files of any size, as a data source.

Files are listed once and dealt out by size; a task streams its files through a small buffer, so no file ever has to fit in
memory or in a row. Paths may be local or of any file system that Arrow knows (``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "path string, length bigint, modificationTime timestamp, file_hash string"
DATA_FILES = ("*.csv", "*.xlsx", "*.xls")
#: Bytes read at a time, and bytes of files of one task; a larger file is a task of its own.
BUFFER, TASK_BYTES = 4 << 20, 256 << 20


def file_system(path: str):
    """An Arrow file system, the path within it, and what stands before paths of it."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    if local.startswith("/") or "://" not in local:
        return fs.LocalFileSystem(), local, "file:"
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: path.index(inner)] if inner in path else path.split("://")[0] + "://"


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.globs = options["path"], options.get("globs", "*").split("|")
        self.recursive = options.get("recursive", "true") == "true"
        self.hashed = options.get("hashed", "true") == "true"
        self.buffer = int(options.get("buffer", BUFFER))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder, before = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=self.recursive, allow_not_found=True))
        files = [(i.path, before + i.path, i.size, i.mtime) for i in found if i.type == fs.FileType.File
                 and not i.base_name.startswith(("_", ".")) and any(fnmatch.fnmatchcase(i.base_name, g) for g in self.globs)]
        parts, size = [], TASK_BYTES
        for f in sorted(files, key=lambda f: -f[2]):
            if size + f[2] > TASK_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f[2]
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system = file_system(self.folder)[0]
        for inner, path, size, time in partition.files:
            digest = hashlib.md5(usedforsecurity=False) if self.hashed else None
            if digest:
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(self.buffer):
                        digest.update(piece)
            yield path, size, time, digest.hexdigest() if digest else None


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "khata_file_digests"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def file_digests(spark: SparkSession, folder: str, globs: tuple[str, ...] = DATA_FILES, hashed: bool = True,
                 recursive: bool = True, buffer: int = BUFFER) -> DataFrame:
    """path, length, modificationTime and file_hash (null unless ``hashed``) of the files in ``folder``; hidden ones are left out."""
    spark.dataSource.register(FileDigests)
    return (spark.read.format("khata_file_digests").option("globs", "|".join(globs)).option("hashed", str(hashed).lower())
            .option("recursive", str(recursive).lower()).option("buffer", buffer).load(folder))
