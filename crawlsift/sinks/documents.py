"""A sink and source of text documents under their export names, bundled in one tar file per task.

`df.write.format("documents").save(path)` takes rows of (name, text). A task writes its bundle under a name of its own attempt; when the job
commits, the bundles of the attempts that count get their final names and all others are removed, so a task that failed, was lost or
ran twice leaves no document behind and none twice. Names must be unique in the table (see `document_names`). Paths are local, shared or
of any file system that Arrow reads by its address.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from crawlsift.functions.sql import lit, substitute
from crawlsift.functions.urls import host_of
from crawlsift.sinks import export_key

SCHEMA = "name string, text string"
_ATTEMPTS, _DONE = "_attempts", "_SUCCESS"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Bundle(WriterCommitMessage):
    part: int
    file: str
    documents: int


@dataclass
class BundlePartition(InputPartition):
    file: str


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        # made once, before any task: one that goes on after its job was aborted finds no folder to write to
        files, folder = _at(f"{path}/{_ATTEMPTS}/{self.job}")
        files.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Bundle:
        """One attempt of a task: its documents in a file of their own."""
        files, folder = _at(f"{self.path}/{_ATTEMPTS}/{self.job}")
        context = TaskContext.get()
        part, file, count = context.partitionId() if context else 0, f"{folder}/{uuid.uuid4().hex}.tar", 0
        with files.open_output_stream(file) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for row in iterator:
                data = (row["text"] or "").encode()
                info = tarfile.TarInfo(row["name"])
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                count += 1
        return Bundle(part, file, count)

    def commit(self, messages: list[Bundle | None]) -> None:
        """Final names for the bundles that count; what else this job's attempts left is removed."""
        files, folder = _at(self.path)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(folder)):
                if old.base_name.endswith(".tar"):
                    files.delete_file(old.path)
        for m in messages:
            if m is not None and m.documents:
                files.move(m.file, f"{folder}/part-{m.part:05d}-{self.job}.tar")
        self._clear()
        with files.open_output_stream(f"{folder}/{_DONE}") as out:
            out.write(b"")

    def abort(self, messages: list[Bundle | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = _at(f"{self.path}/{_ATTEMPTS}/{self.job}")
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[BundlePartition]:
        files, folder = _at(self.path)
        found = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith(".tar")]
        return [BundlePartition(p) for p in sorted(found)] or [BundlePartition("")]

    def read(self, partition: BundlePartition) -> Iterator[tuple[str, str]]:
        if not partition.file:
            return
        files, _ = _at(self.path)
        with files.open_input_stream(partition.file) as source, tarfile.open(fileobj=source, mode="r|") as tar:
            for info in tar:
                yield info.name, tar.extractfile(info).read().decode()


class Documents(DataSource):
    """Format `documents`: rows of (name, text)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def document_names(df: DataFrame, prefix: str, extension: str, date: str, url: str = "url") -> DataFrame:
    """df with `name`: a folder per host, then the export name with the page's id, unique where (host, page_id) is."""
    named = substitute(export_key(lit(prefix), url, lit(extension), date), r"(\.[a-z0-9]+)$", "-<id>$1")
    return df.selectExpr("*", f"concat({host_of(url)}, '/', replace({named}, '<id>', CAST(page_id AS STRING))) AS name")


def write_documents(documents: DataFrame, path: str, text: str = "text", mode: str = "append") -> None:
    """(name, text) as bundles under `path`, committed as a whole."""
    register(documents.sparkSession)
    documents.selectExpr("name", f"{text} AS text").write.format("documents").mode(mode).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("documents").load(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)


__all__ = ["Documents", "document_names", "read_documents", "register", "write_documents"]
