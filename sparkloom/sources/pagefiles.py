"""One file a row: a sink that writes each body under its name.

The format "pagefiles" is a Python data source. Tasks write into a folder of their own; the commit
moves the files of the tasks that count into place, so that a failed or repeated task leaves nothing.

Cases: a null body is an empty file; of rows with equal names that of the last task stays, within a task
the last row; names with a separator, or that are null or empty, are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sparkloom.sources.v1store import open_store


@dataclass
class Written(WriterCommitMessage):
    number: int
    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        folder = f"{root}/_task-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    if not name or "/" in name or name.startswith("_"):
                        raise ValueError(f"no name for a file: {name!r}")
                    with store.open_output_stream(f"{folder}/{name}{self.ending}") as out:
                        out.write((body or "").encode())
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(TaskContext.get().partitionId(), folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        store, root = open_store(self.path)
        for done in sorted((m for m in messages if m), key=lambda m: m.number):
            for found in store.get_file_info(FileSelector(done.folder)):
                store.move(found.path, f"{root}/{found.base_name}")
            store.delete_dir(done.folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)
        for done in messages:
            if done:
                store.delete_dir(done.folder)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options["path"], self.options.get("ending", ""))


def write_page_files(pages: DataFrame, path: str, ending: str = ".md") -> None:
    """A file for each row of name and body."""
    pages.sparkSession.dataSource.register(PageFiles)
    pages.select(F.col("name").cast("string").alias("name"), F.col("body").cast("string").alias("body")).write.format("pagefiles").option("ending", ending).mode("append").save(path)
