"""Mapping rules from a JSON file: an object of statement types, each a list of rules with their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstat.functions.rules import CLASSES
from docstat.functions.text import match_key
from docstat.sources.json_tables import items, whole_files


def mapping_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row for each alias, as rules.aliases gives them: statement_type, field, value_type, rule_ord, class_ord, key.

    rule_ord is a rule's place in its list. A rule without value_type is for numbers, one without a list of aliases has none of that class, and aliases that are
    empty once they are normalised match nothing. A file that is no JSON object, or a rule without canonical_field_name, fails the read.
    """
    read = whole_files(spark, path).select(F.try_parse_json("value").alias("v"))
    types = F.try_variant_get("v", "$", "map<string,variant>")
    checked = read.select(F.explode(F.when(types.isNotNull(), types).otherwise(F.raise_error(F.lit(f"{path} is no JSON object of rules")))).alias("statement_type", "list"))
    rule = checked.select("statement_type", F.posexplode(items(F.col("list"))).alias("rule_ord", "r"))
    text = lambda name: F.try_variant_get("r", f"$.{name}", "string")
    field = F.coalesce(text("canonical_field_name"), F.raise_error(F.lit(f"a rule of {path} has no canonical_field_name")))
    classes = F.explode(F.array(*[F.struct(F.lit(i).alias("class_ord"), items(F.try_variant_get("r", f"$.{name}", "variant")).alias("aliases")) for i, name in enumerate(CLASSES)])).alias("c")
    each = rule.select("statement_type", field.alias("field"), F.coalesce(text("value_type"), F.lit("number")).alias("value_type"), "rule_ord", classes)
    rows = each.select("statement_type", "field", "value_type", "rule_ord", "c.class_ord", F.explode("c.aliases").alias("alias"))
    return rows.select("statement_type", "field", "value_type", "rule_ord", "class_ord", match_key(F.coalesce(F.col("alias").try_cast("string"), F.lit(""))).alias("key")).where("key <> ''")
