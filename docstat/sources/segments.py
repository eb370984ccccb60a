"""A keyed table written batch by batch, of which the last row of a key holds.

A batch is a folder of its own, written whole: one that is run again replaces itself. Readers take the newest finished compaction and the batches after it, so what they read doesn't
grow with the number of batches; a compaction changes no row. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "_batch"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders below path that were written to their end."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return [n for n in names if fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


class Latest:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fields = StructType.fromDDL(schema).fields
        self.columns = [f.name for f in self.fields]
        self.schema = f"{schema}, {BATCH} long"

    def put(self, rows: DataFrame, number: int) -> None:
        """rows: at most one a key."""
        rows.select(*self.columns, F.lit(number).cast("long").alias(BATCH)).write.mode("overwrite").parquet(f"{self.path}/b{number}")

    def _numbers(self) -> tuple[int | None, list[int]]:
        """(the newest compaction, the batches after it)."""
        names = finished(self.spark, self.path)
        base = max((int(n[4:]) for n in names if n.startswith("upto")), default=None)
        return base, sorted(int(n[1:]) for n in names if n.startswith("b") and (base is None or int(n[1:]) > base))

    def batches(self) -> list[int]:
        """The batches that no compaction holds yet."""
        return self._numbers()[1]

    def _rows(self) -> DataFrame:
        base, numbers = self._numbers()
        paths = [f"{self.path}/upto{base}"] * (base is not None) + [f"{self.path}/b{n}" for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        others = F.struct(*[c for c in rows.columns if c != self.key])
        return rows.groupBy(self.key).agg(F.max_by(others, BATCH).alias("r")).select(self.key, "r.*")

    def read(self) -> DataFrame:
        return self._rows().select(*self.columns)

    def compact(self) -> int | None:
        """Write what holds now as one folder; returns the last batch in it."""
        base, numbers = self._numbers()
        if not numbers:
            return base
        self._rows().select(*self.columns, BATCH).write.mode("overwrite").parquet(f"{self.path}/upto{numbers[-1]}")
        return numbers[-1]

    def remove_old(self) -> list[str]:
        """Delete what the newest compaction replaces; readers that opened it before must be done."""
        base, _ = self._numbers()
        names = finished(self.spark, self.path) if base is not None else []
        old = [n for n in names if (n.startswith("upto") and int(n[4:]) < base) or (n.startswith("b") and int(n[1:]) <= base)]
        for name in old:
            remove(self.spark, f"{self.path}/{name}")
        return old
