"""All tables of a document from its parser files, with what went wrong as rows of their own.

A file that can't be read costs its own tables only: it gives an error row, and a document that ends without any table a warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstat.sources import json_tables

# The messages.
ERROR = {"page_table": "tables_json normalization failed: ", "merged_cross_page_table": "merged_tables_json normalization failed: "}
NO_TABLES = "no canonical tables generated"
SOURCE = ("source_type", "source_pages", "table_group_id", "parser_source", "continuation_confidence", "table_intent_score", "quality_flags")


def unreadable(value: Column) -> Column:
    """Why a file gives no tables, or null: it isn't JSON, or no list."""
    return _unreadable(F.try_parse_json(value))


def _unreadable(v: Column) -> Column:
    return F.when(v.isNull(), "not valid JSON").when(~json_tables.is_list(v), "not a list")


def file_errors(files: DataFrame, source_type: str) -> DataFrame:
    """(document_id, severity, message). files: (document_id, value); no row where a document has no such file."""
    why = unreadable(F.col("value"))
    return files.where(why.isNotNull()).select("document_id", F.lit("error").alias("severity"), F.concat(F.lit(ERROR[source_type]), why).alias("message"))


def merged_flags(groups: DataFrame, flags: DataFrame) -> DataFrame:
    """groups (document_id, table_id, source_pages, …) with quality_flags: one list for each source page, in order, empty where there is none.

    flags: (document_id, page_number, flags); a document's flags travel as one map, so a group needs one join for all its pages.
    """
    of_document = flags.groupBy("document_id", "page_number").agg(F.first("flags").alias("flags")).groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("page_number", "flags"))).alias("__flags"))
    none = F.array().cast("array<string>")
    found = F.transform("source_pages", lambda p: F.coalesce(F.try_element_at("__flags", p), none))
    return groups.join(of_document, "document_id", "left").withColumn("quality_flags", found).drop("__flags")


def tables_of(rows: DataFrame, *source: str) -> DataFrame:
    """One row per table of its table rows: its key and source columns."""
    return rows.groupBy("document_id", "table_id", "table_ord").agg(*[F.first(c).alias(c) for c in source])


def sources(page_rows: DataFrame, merged_rows: DataFrame, pages: DataFrame, flags: DataFrame) -> DataFrame:
    """Source columns of every page and merged table.

    pages: the last record of each page (document_id, page_number, parser_source, table_group_id, table_intent_score, quality_flags).
    A page's own flags come before those of the flags file.
    """
    none = F.array().cast("array<string>")
    own = pages.select("document_id", "page_number", "parser_source", "table_group_id", "table_intent_score", F.col("quality_flags").alias("own_flags"))
    page = tables_of(page_rows, "source_type", "source_pages", "page_number").join(own, ["document_id", "page_number"], "left")
    page = page.join(flags.select("document_id", "page_number", F.col("flags").alias("other_flags")), ["document_id", "page_number"], "left")
    listed = F.when(F.size("own_flags") > 0, F.col("own_flags")).otherwise(F.coalesce("other_flags", none))
    page = page.withColumns({"quality_flags": F.when(F.size(listed) > 0, F.array(listed)).otherwise(F.array().cast("array<array<string>>")), "continuation_confidence": F.lit(0.0)})
    merged = merged_flags(tables_of(merged_rows, "source_type", "source_pages", "table_group_id", "continuation_confidence"), flags)
    merged = merged.withColumns({"parser_source": F.lit(""), "table_intent_score": F.lit(0.0)})
    filled = page.select("document_id", "table_id", "table_ord", *SOURCE).unionByName(merged.select("document_id", "table_id", "table_ord", *SOURCE))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("table_group_id", "parser_source")}
    return filled.withColumns({**texts, "table_intent_score": F.coalesce("table_intent_score", F.lit(0.0)), "n_flags": F.size(F.flatten("quality_flags"))})


def normalize(documents: DataFrame, page_files: DataFrame, merged_files: DataFrame, pages: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table rows, source columns of the tables, messages) of all documents. page_files, merged_files: (document_id, value)."""
    page_rows, merged_rows = json_tables.page_tables(page_files), json_tables.merged_tables(merged_files)
    columns = ("document_id", "table_id", "table_ord", "row_index", "cells")
    rows = page_rows.select(*columns).unionByName(merged_rows.select(*columns))
    none = documents.select("document_id").join(rows.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("warning").alias("severity"), F.lit(NO_TABLES).alias("message"))
    messages = file_errors(page_files, "page_table").unionByName(file_errors(merged_files, "merged_cross_page_table")).unionByName(none)
    return rows, sources(page_rows, merged_rows, pages, flags), messages


def file_messages(files: DataFrame) -> DataFrame:
    """The messages of `normalize` alone, for those who don't read the tables: each document's files lie in one row and are parsed once.

    files: (document_id, page_file, merged_file); a file that a document doesn't have is null.
    """
    parsed = files.select("document_id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("page_file", "merged_file")], F.try_parse_json("page_file").alias("page"), F.try_parse_json("merged_file").alias("merged"))
    one = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    error = lambda kind, c, file: F.when(F.col(file) & _unreadable(F.col(c)).isNotNull(), one("error", F.concat(F.lit(ERROR[kind]), _unreadable(F.col(c)))))
    none = F.when(~(json_tables.has_page_rows(F.col("page")) | json_tables.has_merged_rows(F.col("merged"))), one("warning", F.lit(NO_TABLES)))
    found = F.array_compact(F.array(error("page_table", "page", "has_page_file"), error("merged_cross_page_table", "merged", "has_merged_file"), none))
    return parsed.select("document_id", F.inline(found))
