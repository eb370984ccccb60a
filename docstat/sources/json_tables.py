"""Parser output files as rows. JSON is read as variants, so one odd row doesn't lose its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions import text

VARIANTS = "array<variant>"


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, value) of each file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def is_list(v: Column) -> Column:
    """Whether it is a list, told without the types of all that is in it."""
    return v.try_cast(VARIANTS).isNotNull()


def items(v: Column) -> Column:
    """The items of a variant list; anything else has none."""
    return F.coalesce(v.try_cast(VARIANTS), F.array().cast(VARIANTS))


def cell_text(v: Column) -> Column:
    """A cell as text: falsy values are empty, carriage returns are line feeds, white space at the ends goes."""
    kind, raw = F.schema_of_variant(v), F.coalesce(v.try_cast("string"), F.to_json(v))
    number = v.try_cast("double")
    shown = (
        F.when(v.isNull() | (kind == "VOID"), "")
        .when(kind == "BOOLEAN", F.when(v.try_cast("boolean"), "True").otherwise(""))
        .when(kind == "STRING", raw)
        .when(kind.isin("BIGINT"), F.when(number == 0, "").otherwise(raw))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.when(number == 0, "").otherwise(number.cast("string")))
        .when(raw.isin("[]", "{}"), "")
        .otherwise(raw)
    )
    return text.strip(F.regexp_replace(F.coalesce(shown, F.lit("")), "\r", "\n"))


def row_cells(v: Column) -> Column:
    """The cells of a table row; a value that is no list is a row of one cell."""
    return F.transform(F.when(is_list(v), v.cast(VARIANTS)).otherwise(F.array(v)), cell_text)


def place(part: int, outer: Column, inner: Column) -> Column:
    """Order of a table in its document: page tables first, then by page and index, or by group."""
    return F.struct(F.lit(part).alias("part"), outer.cast("int").alias("outer"), inner.cast("int").alias("inner"))


def page_tables(files: DataFrame) -> DataFrame:
    """rows of tables.json. files: (document_id, value). Index and page of a table name it."""
    page = files.select("document_id", F.posexplode(items(F.try_parse_json("value"))).alias("page_ord", "p"))
    number = F.try_variant_get("p", "$.page_number", "int")
    table = page.select("document_id", "page_ord", number.alias("page_number"), F.posexplode(items(F.try_variant_get("p", "$.tables", "variant"))).alias("i", "t"))
    rows = table.select(
        "document_id", "page_number", F.array_compact(F.array("page_number")).alias("source_pages"),
        F.concat_ws("_", F.lit("page_table"), F.coalesce(F.col("page_number").cast("string"), F.lit("unknown")), F.col("i").cast("string")).alias("table_id"),
        place(0, F.col("page_ord"), F.col("i")).alias("table_ord"), F.posexplode(items(F.col("t"))).alias("row_index", "r"),
    )
    return rows.select("document_id", "table_id", "table_ord", "page_number", "source_pages", F.lit("page_table").alias("source_type"), "row_index", row_cells(F.col("r")).alias("cells"))


def merged_tables(files: DataFrame) -> DataFrame:
    """rows of merged_tables.json, the fragments of a group one below the other."""
    group = files.select("document_id", F.posexplode(items(F.try_parse_json("value"))).alias("g_ord", "g"))
    pages = F.transform(F.filter(F.transform(items(F.try_variant_get("g", "$.source_pages", "variant")), lambda p: p.try_cast("string")), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))
    named = group.select("document_id", "g", pages.alias("source_pages"), F.try_variant_get("g", "$.table_group_id", "string").alias("table_group_id"), F.coalesce(F.try_variant_get("g", "$.continuation_confidence", "double"), F.lit(0.0)).alias("continuation_confidence"), "g_ord")
    part = named.select("*", F.posexplode(items(F.try_variant_get("g", "$.tables", "variant"))).alias("f", "t"))
    rows = part.select("*", F.posexplode(items(F.try_variant_get("t", "$.table", "variant"))).alias("i", "r"))
    at = F.row_number().over(_window("document_id", "g_ord", order=("f", "i"))) - 1
    label = F.when(F.size("source_pages") > 0, F.array_join(F.col("source_pages").cast("array<string>"), "_")).otherwise("unknown")
    return rows.select(
        "document_id", F.concat_ws("_", F.lit("merged_cross_page_table"), label, F.col("g_ord").cast("string")).alias("table_id"), place(1, F.col("g_ord"), F.lit(0)).alias("table_ord"),
        "source_pages", F.lit("merged_cross_page_table").alias("source_type"), "table_group_id", "continuation_confidence", at.alias("row_index"), row_cells(F.col("r")).alias("cells"),
    )


def has_page_rows(v: Column) -> Column:
    """Whether `page_tables` finds a row in a parsed tables.json."""
    of_page = lambda p: F.exists(items(F.try_variant_get(p, "$.tables", "variant")), lambda t: F.size(items(t)) > 0)
    return F.exists(items(v), of_page)


def has_merged_rows(v: Column) -> Column:
    """The same of `merged_tables`."""
    of_group = lambda g: F.exists(items(F.try_variant_get(g, "$.tables", "variant")), lambda t: F.size(items(F.try_variant_get(t, "$.table", "variant"))) > 0)
    return F.exists(items(v), of_group)


def _window(*keys: str, order: tuple[str, ...]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def quality_flags(files: DataFrame) -> DataFrame:
    """(document_id, page_number, flags) of quality_flags.json."""
    pages = F.try_variant_get(F.try_parse_json("value"), "$.pages", "map<string,variant>")
    found = files.select("document_id", F.explode(pages).alias("page", "v"))
    return found.select("document_id", F.col("page").try_cast("int").alias("page_number"), F.transform(items(F.col("v")), lambda x: F.coalesce(x.try_cast("string"), F.to_json(x))).alias("flags"))


def summaries(files: DataFrame) -> DataFrame:
    """The fields of summary.json that the quality gate reads; has_summary is false for what is no filled object."""
    v = F.try_parse_json("value")
    count = lambda name: F.size(items(F.try_variant_get(v, f"$.{name}", "variant"))).alias(f"{name}_count")
    return files.select(
        "document_id", (F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "OBJECT<>")).alias("has_summary"), F.try_variant_get(v, "$.pdf_name", "string").alias("pdf_name"),
        F.try_variant_get(v, "$.total_pages", "bigint").alias("total_pages"), count("failed_pages"), count("empty_pages"), count("visual_table_route_pages"),
        F.try_variant_get(v, "$.cross_page_table_candidate_count", "bigint").alias("cross_page_table_candidate_count"), F.try_variant_get(v, "$.heavy_parser_ratio", "double").alias("heavy_parser_ratio"),
        F.try_variant_get(v, "$.ocr_ratio", "double").alias("ocr_ratio"), F.col("value").alias("summary_text"),
    )
