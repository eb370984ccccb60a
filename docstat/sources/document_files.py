"""One file for each document, <document>.<suffix>, written by the tasks that hold the rows.

A task writes into a folder of its own and moves its files to their places when all are written, so a task that fails leaves none and one that runs twice puts the same files again. A document has one
file of a sink: the sink's other suffixes are removed when a new one is put, so a result that was blocked before and is not now leaves no stale file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# The names of the files by sink; the first is that of a document that was let through.
CANDIDATES = ("financial_table_candidates.json", "blocked_extraction.json")
MAPPING = ("statement_field_candidates_refined.json", "blocked_statement_mapping.json")
EXTRACTION = ("minimal_financial_extraction.json", "blocked_minimal_extraction.json")

STAGING = "_writing"


@dataclass
class Put(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffixes: list[str]):
        self.path, self.suffixes, self.job = path.rstrip("/"), suffixes, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Put:
        store, root = self._store()
        own, names = f"{root}/{STAGING}/{self.job}-{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        try:
            for document, suffix, value in iterator:
                name = quote(document, safe=" ()[]=,+@")
                with store.open_output_stream(f"{own}/{name}.{suffix}") as out:
                    out.write(value.encode())
                names.append((name, suffix))
            for name, suffix in names:
                store.move(f"{own}/{name}.{suffix}", f"{root}/{name}.{suffix}")
                for old in self.suffixes:
                    if old != suffix and store.get_file_info(f"{root}/{name}.{old}").is_file:
                        store.delete_file(f"{root}/{name}.{old}")
        finally:
            store.delete_dir(own)
        return Put(len(names))

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = self._store()
        for info in store.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True)):
            if info.base_name.startswith(self.job):
                store.delete_dir(info.path)

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        """What tasks that were lost left in their own folders."""
        self._clear()


class DocumentFiles(DataSource):
    """Options: path, a folder all executors reach, and suffixes, the comma-separated names that replace one another. Rows: document_id, suffix, value."""

    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return "document_id string, suffix string, value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], [s for s in self.options.get("suffixes", "").split(",") if s])


def suffix_of(sink: tuple[str, ...], mode: Column) -> Column:
    """The name that an extraction mode gives a document's file."""
    return F.when(mode.startswith("blocked"), sink[1]).otherwise(sink[0])


def results(documents: DataFrame, *parts: tuple[str, DataFrame, str]) -> DataFrame:
    """(document_id, value): each row of documents as JSON, with lists of its rows of the parts: (name, rows with document_id, the column that orders them, which goes)."""
    for name, rows, order in parts:
        item = F.struct(*[c for c in rows.columns if c not in ("document_id", order)])
        listed = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), item.alias("_item")))), lambda r: r["_item"]).alias(name))
        documents = documents.join(listed, "document_id", "left")
        documents = documents.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return documents.select("document_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write(frame: DataFrame, path: str, sink: tuple[str, ...] = ()) -> None:
    """frame: (document_id, suffix, value), one row a document; without a sink, files of one document stand beside one another."""
    frame.sparkSession.dataSource.register(DocumentFiles)
    frame.select("document_id", "suffix", "value").write.format("document_files").option("path", path).option("suffixes", ",".join(sink)).mode("append").save()
