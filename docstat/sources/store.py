"""Tables in versions and appended parts, which readers see once they are finished, and report files.

A table being read is never overwritten. One writer at a time; readers keep the version they opened.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docstat.sources.segments import finished, remove

LOCAL_SHARED = "/tmp/docstat-shared"
_roots: set[str] = set()


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder below spark.checkpoint.dir, which goes when the driver's Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"{(shared or LOCAL_SHARED).rstrip('/')}/docstat-tables-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove_at_exit, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _remove_at_exit(path: str) -> None:
    session = SparkSession.getActiveSession()
    if session is not None and SparkContext._gateway is not None:
        remove(session, path)


def written(frame: DataFrame, tag: str) -> DataFrame:
    """frame as a table in the folder that spark.checkpoint.dir names: all readers see the same rows, whatever is lost meanwhile. It goes when the driver's Python ends."""
    path = folder(frame.sparkSession, tag)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class VersionedTable:
    """A table whose rows have an ord, as whole versions and what was appended to them.

    A version is a folder v<n>, an append to it a folder v<n>.a<k> of its own, so that appending writes the new rows only; `compact` makes one version of all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _parts(self) -> tuple[int | None, list[int]]:
        """(the newest version, the appends to it)."""
        names = [n.removeprefix("v").partition(".a") for n in finished(self.spark, self.path)]
        now = max((int(v) for v, _, a in names), default=None)
        return now, sorted(int(a) for v, _, a in names if a and int(v) == now)

    def version(self) -> int | None:
        """The highest version that has been written to its end."""
        return self._parts()[0]

    def _paths(self, now: int | None, appends: list[int]) -> list[str]:
        whole = [f"{self.path}/v{now}"] if now else []  # version 0 is empty
        return whole + [f"{self.path}/v{now}.a{a}" for a in appends]

    def read(self) -> DataFrame:
        paths = self._paths(*self._parts())
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, frame: DataFrame) -> int:
        new = (self.version() or 0) + 1
        frame.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        return new

    def append(self, frame: DataFrame) -> int:
        """Without looking for rows that are there already; ord goes on from the end. Only the new rows are written; of the old ones, the last part that has any is read for its end."""
        now, appends = self._parts()
        end = -1
        for path in reversed(self._paths(now, appends)):
            last = self.spark.read.schema(self.schema).parquet(path).agg(F.max("ord")).first()[0]
            if last is not None:
                end = last
                break
        part = (appends[-1] if appends else 0) + 1
        columns = StructType.fromDDL(self.schema).names
        frame.withColumn("ord", F.col("ord") + F.lit(end + 1)).select(*columns).write.mode("overwrite").parquet(f"{self.path}/v{now or 0}.a{part}")
        return part

    def compact(self) -> int:
        """One version of the newest and its appends; every row keeps its ord."""
        now, appends = self._parts()
        return self.replace(self.read()) if appends else now or 0

    def remove_old(self) -> list[str]:
        """Delete the versions before the newest, with their appends; their readers must be done."""
        now, _ = self._parts()
        old = [n for n in finished(self.spark, self.path) if int(n.removeprefix("v").partition(".a")[0]) < (now or 0)]
        for name in old:
            remove(self.spark, f"{self.path}/{name}")
        return old


def write_csv(frame: DataFrame, path: str) -> None:
    """With a header; arrays as JSON."""
    arrays = {c: F.to_json(c) for c, t in frame.dtypes if t.startswith(("array", "struct", "map"))}
    frame.withColumns(arrays).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_mode(frame: DataFrame, path: str) -> None:
    """One folder for each extraction mode."""
    frame.write.mode("overwrite").partitionBy("extraction_mode").json(path)


def to_markdown(frame: DataFrame, columns: list[str], title: str, first: int = 30) -> str:
    """A report of the first rows, rendered on the driver."""
    rows = frame.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).limit(first).collect()
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(columns), line(["---"] * len(columns)), *(line(r) for r in rows), ""])
