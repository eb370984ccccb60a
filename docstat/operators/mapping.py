"""From tables with their rows to field candidates.

rows: (document_id, table_id, table_ord, row_index, cells); tables: what `table_rows` makes of them, with
source_type, source_pages and table_group_id added. A table is one record that holds its rows, and the rules are fixed
values inside the expressions, so fields follow from one grouping by table and one window by document, without a join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstat.functions import rules, text
from docstat.operators import rule_tables
from docstat.operators import tables as table_ops
from docstat.operators.tables import TABLE

KEY = list(TABLE)
UNKNOWN_PERIOD = "unknown_period"
HOLDERS = "shareholder_table"
#: Header rows are among so many rows at the top.
TOP = 3


def row_facts() -> dict[str, Column]:
    """nums, the number each cell parses to; likely, whether a top row looks like a header; periods, its cells that look like a period; the first and last places of numbers and filled cells; key0 and key1, the keys of its first two cells if they can name fields. Rows have `timed` and, as in tables.tables, `cell_facts`."""
    cells, facts = F.col("cells"), F.col("cell_facts")
    numbered = lambda f: f["number"].isNotNull()
    top = F.col("row_index") < TOP
    likely = top & (F.col("timed") | (text.count_of(facts, numbered) <= F.greatest(F.lit(1), F.expr("size(cells) div 3"))))
    periods = text.each(cells, lambda c: F.when(text.looks_like_period(text.match_key(c)), text.strip(c)))
    none = F.array_repeat(F.lit(None).cast("string"), F.size("cells"))  # a row has none unless it looks like one as a whole
    first_number, last_number = text.places_of(facts, numbered, 1)
    first_text, _ = text.places_of(cells, lambda c: F.coalesce(c, F.lit("")) != "", 1)
    _, last_filled = text.places_of(facts, lambda f: ~f["blank"])
    return {
        "nums": facts["number"], "likely": likely, "periods": F.when(top, F.when(F.col("timed"), periods).otherwise(none)),
        "first_number": first_number, "last_number": last_number, "first_text": first_text, "last_filled": last_filled, "key0": label_key(0, last_number, last_filled), "key1": label_key(1, last_number, last_filled),
    }


def timed(rows: DataFrame) -> DataFrame:
    """rows with `timed`, whether a top row looks like a period."""
    top = rows.withColumn("top_text", F.when(F.col("row_index") < TOP, F.array_join("cells", "")))
    return top.withColumn("timed", F.when(F.col("row_index") < TOP, text.looks_like_period(text.match_key(F.col("top_text"))))).drop("top_text")


def table_rows(rows: DataFrame) -> DataFrame:
    """tables.tables with `rows` and the header rows, which are the likely ones, or row 0 where none is: head_rows, their numbers, and head_periods."""
    found = table_ops.tables(timed(rows), **row_facts()).withColumn("any_likely", F.exists("rows", lambda r: r["likely"]))
    heads = F.filter("rows", lambda r: is_header(r["likely"], r["row_index"]))
    return found.withColumns({"head_rows": heads["row_index"], "head_periods": heads["periods"]})


def is_header(likely: Column, row_index: Column) -> Column:
    return F.when(F.col("any_likely"), likely).otherwise(row_index == 0)


def header_rows(tables: DataFrame) -> DataFrame:
    return tables.select(*KEY, F.explode("head_rows").alias("row_index"))


def period_at(col: Column) -> Column:
    """The period of a column: that of the last header row which has one there."""
    return F.coalesce(*[F.get(F.get("head_periods", F.lit(i)), col) for i in reversed(range(TOP))])


def period_columns(tables: DataFrame) -> DataFrame:
    """(table, col_index, period_label)."""
    columns = F.sequence(F.lit(0), F.array_max(F.transform("head_periods", F.size)) - 1)
    found = tables.where(F.exists("head_periods", lambda p: F.size(p) > 0)).select(*KEY, F.posexplode(F.transform(columns, period_at)).alias("col_index", "period_label"))
    return found.where("period_label is not null")


def units(tables: DataFrame) -> DataFrame:
    return tables.withColumns({"unit": text.unit_of(F.col("word_text")), "currency": text.currency_of(F.col("word_text"))})


#: The types of the rules that a key matches, and of what a row's labels name.
MATCHES = "array<struct<rule_ord:int,field:string,value_type:string,class_ord:int>>"
HITS = "array<struct<part:int,at:int,label:string,rule_ord:int,field:string,value_type:string,class_ord:int>>"
#: Rules that are written out one by one, which Spark compiles; more are an array whose items it interprets.
WRITTEN_OUT = 64


def _keys(aliases) -> list[str]:
    return [k for k in ("".join(a.split()).lower() for a in aliases) if k]


def rule_table(kind: str, fields) -> Column:
    """The rules of a statement type as one array of records, fixed inside the expression."""
    texts = lambda aliases: "cast(array(" + ", ".join(f"'{k}'" for k in _keys(aliases)) + ") AS array<string>)"
    one = lambda rule, f: f"('{f[1]}', '{f[2]}', {rule}, {texts(f[3])}, {texts(f[4])}, {texts(f[5])})"
    record = "array<struct<field: string, value_type: string, rule_ord: int, exact: array<string>, phrase: array<string>, weak: array<string>>>"
    return F.expr(f"cast(array({', '.join(one(rule, f) for rule, f in enumerate(fields) if f[0] == kind)}) AS {record})")


def _written_out(k: Column, kind: str, fields, shown, kept) -> Column:
    """What k matches of a type's rules, one expression for each rule."""
    found = []
    for rule, f in enumerate(fields):
        if f[0] != kind:
            continue
        hit = F
        for class_ord, keys in enumerate(map(_keys, f[3:6])):
            if keys:
                test = k.isin(*keys) if class_ord == 0 else reduce(or_, map(k.contains, keys))
                hit = hit.when(test, F.array(shown({"field": F.lit(f[1]), "value_type": F.lit(f[2]), "rule_ord": F.lit(rule), "class_ord": F.lit(class_ord)})))
        if hit is not F:
            found.append(hit.otherwise(F.array().cast(kept)))
    return F.concat(*found) if found else F.array().cast(kept)


def _looked_up(k: Column, kind: str, fields, shown, kept) -> Column:
    """The same from an array of the rules."""
    within = lambda aliases: F.exists(aliases, k.contains)
    best = lambda r: F.when(F.array_contains(r["exact"], k), 0).when(within(r["phrase"]), 1).when(within(r["weak"]), 2)
    return F.filter(F.transform(rule_table(kind, fields), lambda r: shown({"rule_ord": r["rule_ord"], "field": r["field"], "value_type": r["value_type"], "class_ord": best(r)})), lambda m: m["class_ord"].isNotNull())


def _rule(m) -> Column:
    return F.struct(*[m[c].alias(c) for c in ("rule_ord", "field", "value_type", "class_ord")])


def match_rules(kind: Column, key: Column, fields=rules.FIELDS, shown=_rule, kept: str = MATCHES) -> Column:
    """The rules of a statement type that a key matches, under their best class, as records that `shown` makes, of type `kept`. key is read many times: give a column, or what `let` worked out."""
    matched, of_kind = (_written_out if len(fields) <= WRITTEN_OUT else _looked_up), F
    for name in dict.fromkeys(f[0] for f in fields):
        of_kind = of_kind.when(kind == name, matched(key, name, fields, shown, kept))
    return of_kind.otherwise(F.array().cast(kept))


def alias_matches(labels: DataFrame, fields=rules.FIELDS) -> DataFrame:
    """labels (…, label, candidate_statement_type), once for each rule they match."""
    return labels.select("*", F.inline(text.let(text.match_key(F.col("label")), lambda key: match_rules(F.col("candidate_statement_type"), key, fields))))


def weak_context(statement_type: Column, key: Column) -> Column:
    found = F.lit(False)
    for kind, words in rules.WEAK_CONTEXT:
        found = found | ((statement_type == kind) & text.contains_any(key, words))
    return found


def mapping_confidence(class_ord: Column, period: Column, unit: Column, numeric_ratio: Column, merged: Column, failed: Column) -> Column:
    base = F.when(class_ord == 0, F.lit(0.82)).when(class_ord == 1, F.lit(0.72)).when(class_ord == 2, F.lit(0.55)).otherwise(F.lit(0.45))
    score = base + F.when(period, F.lit(0.05)).otherwise(F.lit(-0.08)) + F.when(unit, F.lit(0.04)).otherwise(F.lit(-0.05))
    score = score + F.when(numeric_ratio >= 0.15, F.lit(0.04)).otherwise(F.lit(0.0)) - F.when(merged, F.lit(0.03)).otherwise(F.lit(0.0)) - F.when(failed, F.lit(0.18)).otherwise(F.lit(0.0))
    return text.clamp_score(score)


def class_name(class_ord: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, rules.CLASSES)), class_ord + 1)


def period_places(value_type: Column) -> Column:
    """The places right of a row's first cell that are below a period and have a number, or text."""
    cells, nums = F.col("cells"), F.col("nums")
    filled = lambda i: F.when(value_type == "number", F.get(nums, i).isNotNull()).otherwise(F.coalesce(F.get(cells, i), F.lit("")) != "") & period_at(i).isNotNull()
    few = F.array_compact(F.array(*[F.when(filled(F.lit(i)), i) for i in range(1, text.UNROLLED)]))
    return F.when(F.size(cells) <= text.UNROLLED, few).otherwise(F.filter(F.sequence(F.lit(1), F.size(cells) - 1), filled))


def label_key(i: int, last_number: Column, last_filled: Column) -> Column:
    """The key of the cell in column i of a row if it can name fields, else null: no number itself, with a value to its right."""
    label, fact = F.get("cells", F.lit(i)), F.get("cell_facts", F.lit(i))
    right = (last_number > i) | (last_filled > i) if i == 0 else last_number > i
    return F.when(label.isNotNull() & fact["number"].isNull() & ~fact["blank"] & right, text.match_key(label))


def _hit(part: int, at: Column, label: Column, m: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), at.cast("int").alias("at"), label.alias("label"), *[m[c].alias(c) for c in ("rule_ord", "field", "value_type", "class_ord")])


def _label_hit(i: int):
    """What the label in column i of a row names by a rule."""
    return lambda m: _hit(0, F.lit(i), F.get("cells", F.lit(i)), m)


def _names_fields(i: int) -> Column:
    """Whether the key of the cell in column i counts: not in a header, and with a value of its table's kind to its right."""
    return ~is_header(F.col("likely"), F.col("row_index")) & (F.when(F.col("candidate_statement_type") == HOLDERS, F.col("last_filled")).otherwise(F.col("last_number")) > i)


def column_rules(fields=rules.FIELDS) -> Column:
    """What the cells of row 0 of a shareholder table name in every row below: part 1, at the cell's column."""
    top = F.get(F.filter("rows", lambda r: r["row_index"] == 0), F.lit(0))["cells"]

    def of_cell(c: Column, i: Column) -> Column:
        strong = F.filter(text.let(text.match_key(c), lambda key: match_rules(F.lit(HOLDERS), key, fields)), lambda m: m["class_ord"] < 2)
        return F.transform(strong, lambda m: _hit(1, i, c, m))

    return F.when(F.col("candidate_statement_type") == HOLDERS, F.flatten(F.transform(top, of_cell)))


SOURCE = ("candidate_statement_type", "unit", "currency", "numeric_cell_ratio", "source_type", "source_pages", "table_group_id")


ROW = ("row_index", "cells", "nums", "likely", "first_number", "last_number", "first_text", "last_filled", "key0", "key1")


def _each_row(tables: DataFrame, *more: str) -> DataFrame:
    """The rows of tables beside what the table tells. Those without any go after the generator, see `_fields`."""
    return tables.select(*KEY, *SOURCE, "any_likely", "head_periods", *more, F.inline_outer("rows")).where("row_index is not null").select(*KEY, *SOURCE, "any_likely", "head_periods", *more, *ROW)


def map_fields(tables: DataFrame, fields=rules.FIELDS, all_periods: bool = False) -> DataFrame:
    """Field candidates of all mappable tables, with ord, their order in the document. all_periods: one for each period of a row that has a value, the first value only where there is none."""
    kinds = tuple(dict.fromkeys(f[0] for f in fields))
    # other tables lose their rows here; a filter would work the type out twice
    mapped = F.col("candidate_statement_type").isin(*kinds)
    typed = units(tables).withColumns({"rows": F.when(mapped, F.col("rows")), "column_rules": column_rules(fields)})
    named = [F.when(F.col(f"key{i}").isNotNull() & _names_fields(i), match_rules(F.col("candidate_statement_type"), F.col(f"key{i}"), fields, _label_hit(i), HITS)) for i in (0, 1)]
    return _fields(_each_row(typed, "column_rules"), named, all_periods)


def map_fields_by(tables: DataFrame, rule_rows: DataFrame, all_periods: bool = False) -> DataFrame:
    """`map_fields` with rules as a table (rules.aliases, rule_file.mapping_rules) of any size: each different label meets the rules once, and its rows meet what it matched.

    tables are read three times: for the labels, for the shareholder tables' first rows and for the rows; write them first if they are dear to make.
    """
    typed = units(tables.join(F.broadcast(rule_rows.select(F.col("statement_type").alias("candidate_statement_type")).distinct()), "candidate_statement_type", "left_semi"))
    each = _each_row(typed).withColumns({f"key{i}": F.when(_names_fields(i), F.col(f"key{i}")) for i in (0, 1)})
    top = typed.where(F.col("candidate_statement_type") == HOLDERS).select(*KEY, F.explode(F.filter("rows", lambda r: r["row_index"] == 0)).alias("r"))
    top = top.select(*KEY, F.posexplode("r.cells").alias("col", "label")).withColumn("key", text.match_key(F.col("label")))
    used = each.select(F.col("candidate_statement_type").alias("statement_type"), F.explode(F.array("key0", "key1")).alias("key")).unionByName(top.select(F.lit(HOLDERS).alias("statement_type"), "key"))
    labels = used.where("key is not null and key <> ''").distinct()
    one = F.struct("rule_ord", "field", "value_type", "class_ord")
    matched = rule_tables.alias_matches(labels, rule_rows).groupBy("statement_type", "key").agg(F.sort_array(F.collect_list(one)).cast(MATCHES).alias("found"))
    near = F.broadcast(matched) if rule_tables.small(matched) else matched
    for i in (0, 1):
        own = near.select(F.col("statement_type").alias("candidate_statement_type"), F.col("key").alias(f"key{i}"), F.col("found").alias(f"found{i}"))
        each = each.join(own, ["candidate_statement_type", f"key{i}"], "left")
    strong = F.filter("found", lambda m: m["class_ord"] < 2)
    named = top.join(near.where(F.col("statement_type") == HOLDERS).select("key", strong.alias("found")), "key").select(*KEY, "col", "label", F.explode("found").alias("rule"))
    columns = named.groupBy(*KEY).agg(F.collect_list(_hit(1, F.col("col"), F.col("label"), F.col("rule"))).alias("column_rules"))
    return _fields(each.join(columns, KEY, "left"), [F.transform(f"found{i}", _label_hit(i)) for i in (0, 1)], all_periods)


def _fields(each: DataFrame, named: list[Column], all_periods: bool) -> DataFrame:
    """The field candidates of tables' rows: what their labels name, and their table's first row (column_rules).

    A weak alias counts in its context only; a column's rule for the rows below the first whose cell there isn't empty. Rows without any go after the generator: Spark would make a filter
    before it of the hits' size, which works them out twice more.
    """
    filled = lambda h: (F.col("row_index") > 0) & (F.coalesce(F.get("cells", h["at"]), F.lit("")) != "")
    # Spark interprets what a lambda function reads, so the labels' rules stay outside; with one beside them they are compiled in pieces, not as one method that is too long for the JVM to compile
    hits = F.concat(*[F.coalesce(h, F.array().cast(HITS)) for h in (*named, F.filter("column_rules", filled))])
    found = each.withColumn("hits", hits).select(*KEY, *SOURCE, "head_periods", *ROW, F.inline_outer("hits")).where("field is not null")
    joined = text.let(F.array_join(F.slice("cells", 1, 2), ""), lambda t: weak_context(F.col("candidate_statement_type"), text.match_key(t)))
    found = found.where((F.col("part") == 1) | (F.col("class_ord") < 2) | (F.coalesce(F.col("last_number") > 0, F.lit(False)) & joined))
    below = F.col("part") == 1
    first = F.coalesce(F.when(F.col("value_type") == "number", F.col("first_number")).otherwise(F.col("first_text")), F.lit(1))
    if all_periods:
        found = found.withColumn("periodic", F.when(~below, period_places(F.col("value_type"))))
        found = found.withColumn("source_col_index", F.explode(F.when(below, F.array("at")).when(F.size("periodic") > 0, F.col("periodic")).otherwise(F.array(first))))
    else:
        found = found.withColumn("source_col_index", F.when(below, F.col("at")).otherwise(first))
    place = [F.when(below, F.col("at")).otherwise(F.col("row_index")), F.when(below, F.col("rule_ord")).otherwise(F.col("at")), F.when(below, F.col("row_index")).otherwise(F.col("rule_ord"))]
    period = F.coalesce(period_at(F.col("source_col_index")), F.lit(UNKNOWN_PERIOD))
    value = F.when(F.col("value_type") == "number", F.get("nums", F.col("source_col_index")))
    how = F.when(~below, "row_alias_match").otherwise("shareholder_column_alias_match")
    found = found.select(
        *KEY, *SOURCE, "part", *[p.alias(f"place{i}") for i, p in enumerate(place)], "field", "value_type", "class_ord", "source_col_index",
        F.col("row_index").alias("source_row_index"), F.col("label").alias("raw_field_name"), F.coalesce(F.get("cells", F.col("source_col_index")), F.lit("")).alias("raw_value"),
        period.alias("period_label"), value.alias("normalized_value"), F.concat_ws(":", how, class_name(F.col("class_ord"))).alias("mapping_reason"),
    )
    merged = F.col("source_type") == "merged_cross_page_table"
    failed = (F.col("value_type") == "number") & F.col("normalized_value").isNull()
    confidence = mapping_confidence(F.col("class_ord"), F.col("period_label") != UNKNOWN_PERIOD, F.col("unit") != "unknown", F.col("numeric_cell_ratio"), merged, failed)
    found = found.withColumn("confidence", confidence)
    review = (
        merged | (F.col("raw_value") == "") | text.is_suspicious(F.col("raw_value"), F.col("value_type"), F.col("normalized_value")) | (F.col("period_label") == UNKNOWN_PERIOD)
        | (F.col("unit") == "unknown") | (F.col("class_ord") == 2) | (F.col("confidence") < rules.FIELD_REVIEW_BELOW)
    )
    found = found.withColumn("requires_review", review)
    of_table, of_document = Window.partitionBy(*KEY), Window.partitionBy("document_id")
    found = found.withColumn("ord", F.row_number().over(of_document.orderBy("table_ord", "part", "place0", "place1", "place2", "source_col_index")).cast("long"))
    place = F.col("ord") - F.min("ord").over(of_table)
    found = found.withColumn("__seq", F.when(F.col("part") == 1, place).otherwise(0))
    return found.select(
        "ord", F.concat_ws("_", "table_id", "field", F.col("source_row_index").cast("string"), F.col("source_col_index").cast("string"), F.col("__seq").cast("string")).alias("field_id"),
        "document_id", "table_id", "candidate_statement_type", F.col("field").alias("canonical_field_name"), "raw_field_name", "raw_value", "normalized_value", "unit", "currency", "period_label",
        "source_pages", "source_row_index", "source_col_index", "table_group_id", "source_type", "confidence", "mapping_reason", "requires_review",
    )


def missing_tables(candidates: DataFrame, tables: DataFrame, ordered: bool = False) -> DataFrame:
    """(document_id, message) of mappable candidates whose table isn't there; ordered: with table_ord, where the table stood."""
    place = ["table_ord"] if ordered else []
    mappable = candidates.where(F.col("candidate_statement_type").isin(*rules.MAPPED_TYPES)).select("document_id", "table_id", *place)
    gone = mappable.join(tables.select("document_id", "table_id"), ["document_id", "table_id"], "left_anti")
    return gone.select("document_id", *place, F.concat(F.lit("canonical table not found for candidate table_id="), F.col("table_id")).alias("message"))
