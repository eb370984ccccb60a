"""Whether files have anything but white space in them, read only up to the first character that isn't."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 16
PER_PARTITION = 256


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def filled(stream) -> tuple[bool, int]:
    """(whether there is a character that isn't white space, bytes read). Bytes that are no UTF-8 are skipped."""
    decode, seen = codecs.getincrementaldecoder("utf-8")("ignore").decode, 0
    while chunk := stream.read(CHUNK):
        seen += len(chunk)
        if decode(chunk).strip():
            return True, seen
    return False, seen


class _Reader(DataSourceReader):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = [f.path for f in found if f.is_file and (not self.name or f.base_name == self.name)]
        return [InputPartition(paths[i : i + PER_PARTITION]) for i in range(0, len(paths), PER_PARTITION)]

    def read(self, partition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.value:
            with store.open_input_stream(path, buffer_size=0) as stream:
                yield path, *filled(stream)


class FileProbe(DataSource):
    """Options: path, a folder, and name, of the files wanted (all without it). Rows: path, filled, bytes_read."""

    @classmethod
    def name(cls):
        return "file_probe"

    def schema(self):
        return "path string, filled boolean, bytes_read long"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("name", ""))


def probe(spark: SparkSession, directory: str, name: str = "") -> DataFrame:
    """(path, filled, bytes_read) of the files below a directory."""
    spark.dataSource.register(FileProbe)
    return spark.read.format("file_probe").option("path", directory).option("name", name).load()


def contents(entries: DataFrame, probes: DataFrame, column: str, name: str) -> DataFrame:
    """entries with `name`: 'missing', 'empty' or 'ok' for the file that a path column names, or null where it names none."""
    known = probes.groupBy(F.col("path").alias(column)).agg(F.bool_or("filled").alias("__filled"))
    state = F.when(F.coalesce(column, F.lit("")) == "", F.lit(None)).when(F.col("__filled").isNull(), "missing").when(F.col("__filled"), "ok").otherwise("empty")
    return entries.join(known, column, "left").withColumn(name, state).drop("__filled")
