"""Folders of one file an entity (company files, replays, runs) as a data source: a partition is a batch of files, and filters on the entity choose files by name.

Spark's own readers pass over names that start with `_`, as cached files do, and would open all files to filter by what stands in their names. Files are listed
and opened by pyarrow's file systems (local or mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME, PUSHDOWN = "proofgrid_folder", "spark.sql.python.filterPushdown.enabled"
#: Bytes and files of a partition, at most; a larger file is one by itself.
BATCH_BYTES, BATCH_FILES = 64 << 20, 1000
SCHEMA = "entity string, path string, modified timestamp, text string"


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, float]]  # entity, path, modified


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix, self.suffix = options["path"], options.get("prefix", ""), options.get("suffix", ".json")
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            some = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if some is not None and f.attribute == ("entity",):
                self.wanted = some if self.wanted is None else self.wanted & some
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = pfs.FileSystem.from_uri(self.path) if "://" in self.path else (pfs.LocalFileSystem(), self.path)
        out, held = [Files([])], 0
        for i in sorted(fs.get_file_info(pfs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            name = i.base_name
            if i.type != pfs.FileType.File or not (name.startswith(self.prefix) and name.endswith(self.suffix)):
                continue
            entity = name[len(self.prefix) : len(name) - len(self.suffix)]
            if self.wanted is not None and entity not in self.wanted:
                continue
            if out[-1].files and (held + i.size > BATCH_BYTES or len(out[-1].files) >= BATCH_FILES):
                out.append(Files([]))
                held = 0
            out[-1].files.append((entity, i.path, i.mtime.timestamp()))
            held += i.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs = pfs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pfs.LocalFileSystem()
        for entity, path, modified in partition.files:
            with fs.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            row = [[entity], [path], [datetime.fromtimestamp(modified, timezone.utc)], [text]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string()), strict=True)], ["entity", "path", "modified", "text"])


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self.options)


def read_folder(spark: SparkSession, path: str, prefix: str = "", suffix: str = ".json") -> DataFrame:
    """(entity, path, modified, text) of the files of a folder and those below it, named prefix, entity, suffix. `entity = ...` and `entity in (...)` open these files only;
    that needs Spark's filter pushdown for Python sources, which is switched on for the session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FolderSource)
    return spark.read.format(NAME).options(prefix=prefix, suffix=suffix).load(path)
