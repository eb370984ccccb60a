"""Secret scan over a ledger of content-addressed blobs; DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its text. The ledger is a table of files at a path, with one row
for each (blob, rule version) pair that has been scanned and the spans found in it, also when there are
none; it holds no text. A run scans only the pairs that the ledger lacks, appends them, and joins the findings back to all
paths, so copies of a text and texts known from earlier runs are not searched again. `find` takes a history in
instalments, each of which skips what the ones before have scanned. Every path has its blob in the ledger; one that a large share of the paths
have is a hot key, whose findings are broadcast (`join_hot`).

Rules (leftmost, non-overlapping per kind; a match that fails its test is dropped and not retried):
assign  a keyword in either case, an optional quote, `:` or `=`, an optional quote, and a value of 6 or more characters
access  AKIA and capitals or digits, 20 or more characters in all
hex     a run of lower-case hexadecimal digits, 24 or longer

Defined results: a null text is the empty text; each row of the input gives one row, repeated
rows too; a null doc_id stays null; an empty table gives an empty table and leaves the ledger as it is; other columns are not read. A pair
that two runs at once have appended counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.llm.common import exists, join_hot, scratch, stage, text_or_empty
from docstat.llm.spans import SPAN, joined, mask, spans

RULE_VERSION = "v1"
KINDS = ("assign", "access", "hex")
VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
ASSIGN = ASSIGN_HEAD + VALUE + "++"
LEDGER = f"blob_id string, rule_version string, findings {SPAN}"
INSTALMENTS = 2


def findings(text: Column) -> Column:
    """All findings of a text, by start and then by kind as KINDS lists them."""
    assign = spans(text, "assign", ASSIGN, lambda m: F.char_length(F.regexp_replace(m, "^" + ASSIGN_HEAD, "")) >= 6, text.rlike("(?i)password|passwd|secret|token|api_?key"))
    access = spans(text, "access", "AKIA[A-Z0-9]{16,}+", may=text.contains("AKIA"))
    hexes = spans(text, "hex", "[0-9a-f]{24,}+", may=text.rlike("[0-9a-f]{24}"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    before = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((rank(a) - rank(b)).cast("int"))
    return F.array_sort(F.concat(assign, access, hexes), before)


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob_id, text) of each version."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; one without files is empty."""
    return spark.read.schema(LEDGER).parquet(path) if exists(path) else spark.createDataFrame([], LEDGER)


def scan_unseen(seen_versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs that ledger lacks. Each task passes on one text a blob, so no blob's copies meet in one place, and the ledger is looked up for what is left."""
    known = ledger.where(F.col("rule_version") == rule_version).select("blob_id").distinct().withColumn("known", F.lit(True))
    # An anti join would be moved below the grouping, and the copies of a text with it.
    blobs = seen_versions.groupBy("blob_id").agg(F.first("text").alias("text")).join(known.hint("merge"), "blob_id", "left").where("known is null")
    return blobs.select("blob_id", F.lit(rule_version).alias("rule_version"), findings(F.col("text")).alias("findings"))


def update_ledger(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Append what the ledger at path lacks; nothing that is there is read again or rewritten. The ledger after this run."""
    spark = docs.sparkSession
    scan_unseen(versions(docs), ledger_at(spark, path), rule_version).write.mode("append").parquet(path)
    return ledger_at(spark, path)


def find(docs: DataFrame, path: str | None = None, rule_version: str = RULE_VERSION, instalments: int = INSTALMENTS) -> DataFrame:
    """doc_id and findings of each row of docs. path: of the ledger to keep; without one the run has its own."""
    path = path or scratch(docs.sparkSession, "ledger")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(instalments))
    for i in range(instalments):
        ledger = update_ledger(docs.where(turn == i), path, rule_version)
    known = ledger.where(F.col("rule_version") == rule_version).groupBy("blob_id").agg(F.first("findings").alias("findings"))
    paths = stage(versions(docs).select(F.col("path").alias("doc_id"), "blob_id"), "paths")
    copies = paths.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n"))
    return join_hot(paths, known.join(copies.hint("merge"), "blob_id"), "blob_id", paths.count()).select("doc_id", "blob_id", "findings")


def digest_columns(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("findings")), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


__all__ = ["find", "findings", "ledger_at", "mask", "scan_unseen", "update_ledger", "versions"]

_SPANS_SQL = """
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, m, s + 0 AS start, s + length(m) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m,
      unnest([list_sum([length(x) FOR x IN gs[:i]]) + coalesce(list_sum([length(x) FOR x IN ms[:i - 1]]), 0) FOR i IN range(1, len(ms) + 1)]) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs FROM d)) WHERE {keep}
"""
_P = "'(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+'"
_H = "'^(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?'"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_SPANS_SQL.format(kind='assign', rank=0, p=_P, keep=f"length(regexp_replace(m, {_H}, '')) >= 6")} UNION ALL
{_SPANS_SQL.format(kind='access', rank=1, p="'AKIA[A-Z0-9]+'", keep='length(m) >= 20')} UNION ALL
{_SPANS_SQL.format(kind='hex', rank=2, p="'[0-9a-f]+'", keep='length(m) >= 24')}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
