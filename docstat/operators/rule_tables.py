"""Rules as tables of any size: "contains" as an equi-join.

A pattern is looked for under one of its n-grams, the one that the fewest texts have, and what meets there is checked. So neither a text meets every pattern nor a frequent n-gram brings
the texts together, unless a pattern has no other; a pattern with an n-gram that no text has is out at once. Texts are keys, made by match_key, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an n-gram.
GRAM = 2
#: Patterns that are broadcast at most; more meet the texts' n-grams by a shuffle.
BROADCAST_PATTERNS = 100_000


def _grams(frame: DataFrame, column: str, size: int) -> DataFrame:
    """frame with gram, once for each different n-gram of a column."""
    last = F.char_length(column) - size + 1
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(column), i, F.lit(size)))
    return frame.where(last >= 1).withColumn("gram", F.explode(F.array_distinct(grams)))


def small(patterns: DataFrame) -> bool:
    return patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS


def contained(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern) of each key of keys (key) that contains a pattern of patterns (pattern); both are distinct, empty patterns are in no key."""
    few = small(patterns)
    near = (lambda f: F.broadcast(f)) if few else (lambda f: f)
    found = None
    for size, own in ((1, patterns.where(F.char_length("pattern").between(1, GRAM - 1))), (GRAM, patterns.where(F.char_length("pattern") >= GRAM))):
        if size == 1 and own.isEmpty():
            continue
        wanted = _grams(own, "pattern", size)
        have = _grams(keys.select("key"), "key", size).join(near(wanted.select("gram").distinct()), "gram", "left_semi")
        often = have.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        chosen = wanted.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
        hits = have.join(near(chosen.drop("n")), "gram").where(F.col("key").contains(F.col("pattern"))).select("key", "pattern")
        found = hits if found is None else found.unionByName(hits)
    return found


def alias_matches(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """(statement_type, key, field, value_type, rule_ord, class_ord): each rule that a label matches, under its best class.

    labels: (statement_type, key), distinct; rules: one row for each alias, as rules.aliases gives them. Exact aliases must equal the key, the others be in it.
    """
    exact = labels.join(rules.where("class_ord = 0"), ["statement_type", "key"])
    named = ("statement_type", "key", "field", "value_type", "rule_ord", "class_ord")
    partial = rules.where("class_ord > 0").withColumnRenamed("key", "pattern")
    pairs = contained(labels.where("key <> ''").select("key").distinct(), partial.select("pattern").distinct())
    of_kind = labels.join(pairs, "key").join(partial, ["statement_type", "pattern"])
    rows = exact.select(*named).unionByName(of_kind.select(*named))
    return rows.groupBy("statement_type", "key", "rule_ord").agg(F.min("class_ord").alias("class_ord"), F.first("field").alias("field"), F.first("value_type").alias("value_type")).select(*named)


def first_matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts (key, …) with ord, the lowest of the patterns (ord, pattern) that its key contains; null where none is."""
    pairs = contained(texts.select("key").distinct(), patterns.select("pattern").distinct()).join(patterns, "pattern")
    return texts.join(pairs.groupBy("key").agg(F.min("ord").alias("ord")), "key", "left")
