"""Canonical tables from rows of cells.

rows: (document_id, table_id, table_ord, row_index, cells array<string>), one row per table row, empty rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text

TABLE = ("document_id", "table_id", "table_ord")


def statement_type(raw_text: Column) -> Column:
    return text.first_label(F.lower(raw_text), rules.STATEMENT_KEYWORDS)


def table_id(source_type: Column, pages: Column, index: Column) -> Column:
    named = F.when(F.size(pages) > 0, F.array_join(pages.cast("array<string>"), "_")).otherwise("unknown")
    return F.concat_ws("_", source_type, named, index.cast("string"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def tables(rows: DataFrame, **facts: Column) -> DataFrame:
    """Quality, raw text and statement type of each table; ratios also unrounded, as *_exact.

    facts: columns of a row to keep: with them the result also has `rows`, an array of (row_index, cells, facts) in
    order, so that whatever reads rows and table together needs no join. They are worked out before the rows are grouped, and may read `cell_facts`, what text.cell_facts tells of each cell.
    word_text is raw_text with 0 for each number: the shorter text for what is looked for and has no digit.
    """
    kept = F.struct("row_index", "cells", *[c.alias(n) for n, c in facts.items()], "words") if facts else F.struct("row_index", "cells", "words")
    words = text.join_each(F.col("cells"), lambda c, f: F.when(f["numeric"], "0").otherwise(c), F.col("cell_facts"), "\t")
    measured = rows.withColumn("cell_facts", text.each(F.col("cells"), text.cell_facts)).withColumn("words", words).select(
        *TABLE,
        "row_index",
        F.size("cells").alias("width"),
        text.count_of(F.col("cell_facts"), lambda f: f["blank"]).alias("empty"),
        text.count_of(F.col("cell_facts"), lambda f: f["numeric"]).alias("numeric"),
        kept.alias("row"),
    )
    found = measured.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("width").cast("long").alias("col_count"),
        F.sum("width").alias("cell_count"),
        F.sum("empty").alias("empty_cells"),
        F.sum("numeric").alias("numeric_cells"),
        F.max(F.when((F.col("row_index") == 0) & (F.col("empty") < F.col("width")), True).otherwise(False)).alias("has_header"),
        F.sort_array(F.collect_list("row")).alias("rows"),
    )
    slots = F.col("row_count") * F.col("col_count")
    found = found.withColumns(
        {"empty_ratio_exact": ratio(F.col("empty_cells"), slots), "numeric_ratio_exact": ratio(F.col("numeric_cells"), F.col("cell_count")), "raw_text": F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], "\t")), "\n"), "word_text": F.array_join(F.col("rows")["words"], "\n")}
    )
    found = found.withColumns(
        {
            "empty_cell_ratio": F.bround("empty_ratio_exact", 4),
            "numeric_cell_ratio": F.bround("numeric_ratio_exact", 4),
            "candidate_statement_type": text.first_in_any_case(F.col("word_text"), rules.STATEMENT_KEYWORDS),
        }
    )
    return found if facts else found.drop("rows")


#: What a cell of a number is made of: no type is told by it.
NO_WORD = r"\A[0-9(),.%％\-]*\z"


def types(rows: DataFrame) -> DataFrame:
    """(table, candidate_statement_type), equal to that of `tables`, for those who read nothing else: words of a type hold no tab and no line feed, so a table's text has one where a cell has it, and a grouping without the rows tells the first type."""
    words = text.join_each(F.col("cells"), lambda c, _: F.when(~c.rlike(NO_WORD), c), F.col("cells"), "\t")
    place = F
    for i, (_, keywords) in enumerate(rules.STATEMENT_KEYWORDS):
        place = place.when(F.col("words").rlike(text.in_any_case(keywords)), i)
    first = rows.withColumn("words", words).groupBy(*TABLE).agg(F.min(place).alias("place"))
    named = F.get(F.array(*[F.lit(kind) for kind, _ in rules.STATEMENT_KEYWORDS]), F.col("place"))
    return first.select(*TABLE, F.coalesce(named, F.lit("unknown")).alias("candidate_statement_type"))


def markdown(rows: DataFrame) -> DataFrame:
    """raw_markdown of each table: a padded header, a rule, the other rows; no rows give an empty text."""
    whole = rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("r"), F.max(F.size("cells")).alias("w"))
    padded = F.transform("r", lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("w") - F.size(r["cells"]))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    lines = F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size("r"), F.lit(1))))
    return whole.select(*TABLE, F.when(F.col("w") > 0, F.array_join(lines, "\n")).otherwise("").alias("raw_markdown"))


def cells(rows: DataFrame) -> DataFrame:
    """The long form: one row per cell; the first row's cells are headers."""
    return rows.select(*TABLE, "row_index", F.posexplode("cells").alias("col_index", "text")).withColumn("is_header", F.col("row_index") == 0)


def canonical(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One record a table, as the canonical contract has it: table_id, title, source, quality, cells, raw_text, raw_markdown, candidate_statement_type, from one grouping of its rows.

    sources: (table, source_type, source_pages, and, where they are known, title, source_file, parser_source, table_group_id, continuation_confidence, table_intent_score, quality_flags). Parsers
    tell no spans and no confidence of a cell: both are 1. A title counts for the statement type.
    """
    known = {c.lower() for c in sources.columns}
    or_else = lambda c, kind, none: F.coalesce(F.col(c), F.lit(none)).cast(kind).alias(c) if c in known else F.lit(none).cast(kind).alias(c)
    flags = F.coalesce("quality_flags", F.array()) if "quality_flags" in known else F.array()
    made = tables(rows, none=F.lit(None).cast("string")).join(sources, list(TABLE))
    one = lambda r, c, i: F.struct(
        r["row_index"].alias("row_index"), i.alias("col_index"), c.alias("text"), text.strip(c).alias("normalized_text"), (r["row_index"] == 0).alias("is_header"),
        F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(1.0).alias("confidence"),
    )
    cell_list = F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c, i: one(r, c, i))))
    padded = F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), (F.col("col_count") - F.size(r["cells"])).cast("int"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("col_count").cast("int")), " | "), F.lit(" |"))
    shown = F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size("rows"), F.lit(1)))), "\n")
    title = or_else("title", "string", "")
    return made.select(
        *TABLE, title,
        F.struct(or_else("source_file", "string", ""), "source_pages", or_else("parser_source", "string", ""), or_else("table_group_id", "string", ""), "source_type").alias("source"),
        F.struct("has_header", "row_count", "col_count", "empty_cell_ratio", "numeric_cell_ratio", or_else("continuation_confidence", "double", 0.0), or_else("table_intent_score", "double", 0.0), flags.alias("quality_flags")).alias("quality"),
        cell_list.alias("cells"), "raw_text", F.when(F.col("col_count") > 0, shown).otherwise("").alias("raw_markdown"),
        statement_type(F.concat_ws("\n", title, "raw_text")).alias("candidate_statement_type"),
    )


def rows_of(cell_rows: DataFrame) -> DataFrame:
    """Rows again from sparse cells: missing rows vanish, missing columns are empty."""
    grouped = cell_rows.groupBy(*TABLE, "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", "text"))).alias("m"), F.max("col_index").alias("w"))
    full = F.transform(F.sequence(F.lit(0), F.col("w")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return grouped.select(*TABLE, (F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("row_index")) - 1).alias("row_index"), full.alias("cells"))


def join_fragments(fragments: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows of a cross-page group, its fragments one below the other: (group, row_index, cells).

    fragments: (group, fragment_ord, row_ord, cells).
    """
    order = Window.partitionBy(group).orderBy("fragment_ord", "row_ord")
    return fragments.select(group, (F.row_number().over(order) - 1).alias("row_index"), "cells")


def lookup_flags(records: DataFrame, pages: DataFrame, flags: DataFrame) -> DataFrame:
    """Page tables with their page's record and flags; a page's own flags come first where there are any."""
    own = pages.select("document_id", "page_number", F.col("quality_flags").alias("own_flags"), "parser_source", "table_group_id", "table_intent_score")
    other = flags.select("document_id", "page_number", F.col("flags").alias("other_flags"))
    joined = records.join(own, ["document_id", "page_number"], "left").join(other, ["document_id", "page_number"], "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("quality_flags", F.when(F.size("own_flags") > 0, F.col("own_flags")).otherwise(F.coalesce("other_flags", none))).drop("own_flags", "other_flags")


def last_by_page(records: DataFrame) -> DataFrame:
    """The last record of each page; page 0 and records without a page are dropped."""
    known = records.where(F.col("page_number").isNotNull() & (F.col("page_number") != 0))
    return known.groupBy("document_id", "page_number").agg(F.max_by(F.struct(*records.columns), "line_no").alias("r")).select("r.*")
