"""The registry of parsed documents and its point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import quality
from docstat.sources.file_probe import contents


def newest(entries: DataFrame, limit: int, level: str | None = None, time: str = "registered_at", by: str = "parse_quality_level") -> DataFrame:
    """The latest entries, ties in insertion order; a negative limit counts as 0."""
    kept = entries if level is None else entries.where(F.col(by) == level)
    return kept.orderBy(F.col(time).desc(), F.col("ord")).limit(max(0, limit))


def by_task(entries: DataFrame, task_id: str) -> DataFrame:
    return entries.where(F.col("parse_task_id") == task_id)


def by_pdf_path(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.regexp_replace("pdf_path", r"\\", "/") == path.replace("\\", "/"))


def by_document(entries: DataFrame, document_id: str) -> DataFrame:
    """The first entry of a document."""
    return entries.where(F.col("document_id") == document_id).orderBy("ord").limit(1)


def duplicate_tasks(entries: DataFrame, key: str = "parse_task_id") -> DataFrame:
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, key: str = "parse_task_id", in_place: bool = True) -> DataFrame:
    """old with the rows of new put in by key.

    in_place: a replaced row keeps its ord (all rows of that key become the new one); otherwise it is
    removed and the new one goes to the end. New rows without a key, or with a new one, go to the end in the order of new.
    """
    keyed = new.where((F.col(key) != "") & F.col(key).isNotNull())
    kept = old.join(keyed.select(key), key, "left_anti").select(*old.columns)
    end = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("end"))
    if not in_place:
        added = new.crossJoin(F.broadcast(end)).withColumn("ord", F.col("ord") + F.col("end") + 1).select(*old.columns)
        return kept.unionByName(added)
    places = old.select(key, F.col("ord").alias("old_ord"))
    placed = new.join(places, key, "left").crossJoin(F.broadcast(end))
    placed = placed.withColumn("ord", F.when(F.col("old_ord").isNotNull() & (F.col(key) != ""), F.col("old_ord")).otherwise(F.col("ord") + F.col("end") + 1))
    return kept.unionByName(placed.select(*old.columns))


def entries(manifests: DataFrame, as_of: str) -> DataFrame:
    """Registry entries of assessed manifests: ids, names, paths, counts and the time of registration."""
    return manifests.withColumns(
        {
            "document_id": text.document_id(F.col("pdf_path"), F.col("parse_task_id")),
            "pdf_name": text.basename(F.col("pdf_path")),
            "registered_at": F.lit(as_of),
        }
    )


def manifest(results: DataFrame) -> DataFrame:
    """Task results with each file's path; a path that isn't given is output_dir/<file>."""
    files = (("summary", "summary.json"), ("pages", "pages.jsonl"), ("merged", "merged.md"), ("tables", "tables.json"), ("merged_tables", "merged_tables.json"), ("quality_flags", "quality_flags.json"), ("cross_page_table_candidates", "cross_page_table_candidates.jsonl"))
    path = lambda name, file: F.coalesce(F.try_element_at("output_files", F.lit(name)), F.concat_ws("/", "output_dir", F.lit(file)))
    return results.withColumns({f"{name}_path": path(name, file) for name, file in files})


# Names that a manifest gives to an entry's columns.
MANIFEST = (("document_id", "document_id"), ("task_id", "parse_task_id"), ("pdf_name", "pdf_name"), *((c, c) for c in rules.PARSE_FILES))


def manifest_of(entries: DataFrame) -> DataFrame:
    """The manifest of registry entries; what an entry lacks is empty."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in entries.columns else F.lit("")
    return entries.select(*[have(c).alias(name) for name, c in MANIFEST])


# The names under which a manifest may give its task and its table files, first come first.
MANIFEST_KEYS = (
    ("document_id", ("document_id",)), ("task_id", ("task_id", "parse_task_id")), ("pdf_name", ("pdf_name",)), ("tables_path", ("tables_json_path", "tables_json")),
    ("merged_tables_path", ("merged_tables_json_path", "merged_tables_json")), ("quality_flags_path", ("quality_flags_path", "quality_flags_json")), ("pages_path", ("pages_jsonl_path", "pages_jsonl")),
)


def manifest_files(manifests: DataFrame) -> DataFrame:
    """What normalisation reads of manifests, which name it in either of two ways: the first that is there and not empty, else an empty text."""
    have = lambda names: [F.nullif(F.col(c), F.lit("")) for c in names if c in manifests.columns]
    return manifests.select(*[F.coalesce(*have(names), F.lit("")).alias(name) for name, names in MANIFEST_KEYS])


def ingest(results: DataFrame, summaries: DataFrame, files: DataFrame, probes: DataFrame, as_of: str) -> DataFrame:
    """Task results to assessed registry entries, ready for `upsert`.

    results: (parse_task_id, pdf_path, output_dir, output_files, parse_status, ord); summaries: by document_id = parse_task_id, as
    json_tables.summaries gives them, with flag_counts; files: (parse_task_id, pages_count); probes: (path, filled) of the merged.md files, as file_probe.probe gives them.
    """
    read = summaries.withColumnRenamed("document_id", "parse_task_id").drop("pdf_name", "summary_text")
    whole = manifest(results).join(read, "parse_task_id", "left").join(files, "parse_task_id", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))
    return quality.assess(entries(contents(whole, probes, "merged_path", "merged_md"), as_of))
