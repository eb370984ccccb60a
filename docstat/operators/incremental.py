"""Stage results that can't go stale: they are kept under the content they were made from.

A document's fingerprint is a digest of its files' names and contents and of the stage's version. A stage runs on documents whose fingerprint isn't in its ledger, and its results are kept with the
fingerprint; what holds is what the documents' present fingerprints name. A file that changes back finds its old results; nothing is overwritten or looked up by name alone.

Defined results: a document without files has a fingerprint too, that of no files; a null content differs from an empty one; the order and repetition of file rows don't matter; a document whose
stage gives no rows is in the ledger and not run again; documents that are gone are in no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docstat.sources.segments import finished, remove

PRINT = "_fingerprint"


def fingerprints(documents: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """(document_id, _fingerprint) of each document. files: (document_id, name, digest), a row a file; see `digests`."""
    one = F.sha2(F.to_json(F.struct("name", "digest"), {"ignoreNullFields": "false"}), 256)
    of_files = files.select("document_id", one.alias("f")).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("fs"))
    joined = documents.select("document_id").distinct().join(of_files, "document_id", "left")
    return joined.select("document_id", F.sha2(F.concat_ws("|", F.lit(version), F.coalesce("fs", F.lit(""))), 256).alias(PRINT))


def digests(files: DataFrame) -> DataFrame:
    """(document_id, name, digest) of files (document_id, name, value)."""
    return files.select("document_id", "name", F.sha2("value", 256).alias("digest"))


class StageResults:
    """The results of one stage: for each run a folder r<n> of rows and, written after it, one of ledger entries: l<n>, or k<n> for a run that holds all before it."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = StructType.fromDDL(schema).names
        self.schema, self.ledger_schema = f"{schema}, {PRINT} string", f"document_id string, {PRINT} string"

    def _ledgers(self) -> list[str]:
        """The ledgers of the runs that count, in order."""
        names = [n for n in finished(self.spark, self.path) if n[0] in "kl"]
        whole = max((int(n[1:]) for n in names if n[0] == "k"), default=-1)
        return sorted((n for n in names if int(n[1:]) > whole or n == f"k{whole}"), key=lambda n: int(n[1:]))

    def _next(self) -> int:
        return int(self._ledgers()[-1][1:]) + 1 if self._ledgers() else 0

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _rows(self) -> DataFrame:
        return self._read([f"r{n[1:]}" for n in self._ledgers()], self.schema)

    def unseen(self, prints: DataFrame) -> DataFrame:
        """The documents that have to be run."""
        return prints.join(self._read(self._ledgers(), self.ledger_schema), ["document_id", PRINT], "left_anti")

    def update(self, prints: DataFrame, run: Callable[[DataFrame], DataFrame]) -> int:
        """Run the stage for unseen documents; run(documents) gives their rows, with document_id. Returns their number.

        The list of documents is written first, so the rows and the ledger speak of the same ones whatever is lost meanwhile.
        """
        number = self._next()
        self.unseen(prints).write.mode("overwrite").parquet(f"{self.path}/t{number}")
        todo = self.spark.read.schema(self.ledger_schema).parquet(f"{self.path}/t{number}")
        n = todo.count()
        if n:
            rows = run(todo.select("document_id")).join(todo, "document_id")
            rows.select(*self.columns, PRINT).write.mode("overwrite").parquet(f"{self.path}/r{number}")
            todo.write.mode("overwrite").parquet(f"{self.path}/l{number}")
        remove(self.spark, f"{self.path}/t{number}")
        return n

    def read(self, prints: DataFrame) -> DataFrame:
        """The rows that hold for the documents' present files."""
        return self._rows().join(prints, ["document_id", PRINT], "left_semi").select(*self.columns)

    def keep(self, prints: DataFrame) -> int:
        """Rewrite as one run what holds now, then delete the runs before; returns their number."""
        old = self._ledgers()
        if not old:
            return 0
        number, on = self._next(), ["document_id", PRINT]
        self._rows().join(prints, on, "left_semi").write.mode("overwrite").parquet(f"{self.path}/r{number}")
        self._read(old, self.ledger_schema).join(prints, on, "left_semi").distinct().write.mode("overwrite").parquet(f"{self.path}/k{number}")
        for name in old:
            remove(self.spark, f"{self.path}/{name}")
            remove(self.spark, f"{self.path}/r{name[1:]}")
        return len(old)
