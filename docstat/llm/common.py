"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"

#: Where a local session without spark.checkpoint.dir keeps its tables (tests).
LOCAL_SHARED = "/tmp/docstat-shared"
#: A key with more than this share of a table's rows is hot; a table has at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: A key with this many rows or fewer is no burden to a task, whatever its share.
FEW_ROWS = 1000

_recording: list[list[str]] = []
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SHARED)
        found = LOCAL_SHARED
    return found.rstrip("/")


def _file_system(path: str):
    context = SparkContext._active_spark_context
    p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context and context._jsc else SparkContext._jvm.org.apache.hadoop.conf.Configuration()
    return p.getFileSystem(conf), p


def exists(path: str) -> bool:
    fs, p = _file_system(path)
    return fs.exists(p)


def delete(path: str) -> None:
    fs, p = _file_system(path)
    fs.delete(p, True)


def _delete_at_exit(path: str) -> None:
    if SparkContext._gateway is not None:
        delete(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder, which goes when the driver's Python ends."""
    root = f"{shared_dir(spark)}/docstat-{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_delete_at_exit, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are taken inside, so that the caller can delete them once nothing reads them."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The written rows are the ones every later reader sees, even when executors are lost
    and the tasks that made them would deal them out differently a second time.
    """
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/docstat-" in name:
            delete(name)


def is_hot(total: int) -> Column:
    """Whether a key with n of a table's `total` rows is hot."""
    return F.col("n") > max(HOT_SHARE * total, FEW_ROWS)


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of big, of `total` rows, with small, whose column n tells how many rows of big have the key.

    The hot keys, at most 1 / HOT_SHARE, have their rows of small broadcast and leave big before the shuffle; the rest meets by a shuffle in which no
    key has more than HOT_SHARE of big's rows, or FEW_ROWS. small has a few rows a key.
    """
    hot, rest = small.where(is_hot(total)).drop("n"), small.where(~is_hot(total)).drop("n")
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(cold.join(rest.hint("merge"), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, whatever case its names are in."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Remembered(dict):
    """A bounded memory of a Python worker: two generations, of which the older is forgotten when the younger is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit // 2, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def lacks(self, keys) -> list:
        """The keys that must be learnt; what it has of the others stays until the next call."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        old = self.old
        return [k for k in keys if k not in self and k not in old]
