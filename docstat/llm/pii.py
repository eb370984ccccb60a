"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Regular expressions give the base spans, which are also the seeds. Candidates are runs of
identifier-like words (they hold a digit or `@`). A candidate has up to two lexical patterns: the two words left of it,
and the word on either side; digits in them are 0, and another candidate is `<id>`. Patterns and candidate strings
(instances) form a graph. Each round scores a pattern for the kind that most of its known instances have: what they add up to over all of
its known instances and a share of the unknown ones. Candidates that have the form of a kind and fail its check are known to be no identifiers.
Patterns that are confident, and supported by enough seeds or instances found in earlier rounds, score the instances they
occur with. At the end a candidate outside all base spans is added where both speak for the same kind: its instance, by its score, and
a pattern at this very place.

The tables hold hashes of instances and patterns, and positions, but no text. All of it is joins and grouped sums on narrow rows; a pattern or an
instance that a third of the corpus shares is a hot key, whose one row of the other side is broadcast (`join_hot`).

Defined results: a null text is empty; each row gives one row, repeated rows the same spans;
a null doc_id stays null; an empty table gives an empty table; texts of any length, and any number of matches in one, cost in proportion; columns other
than doc_id and text are not read by `find` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import free_name, join_hot, stage, text_or_empty
from docstat.llm.spans import SPAN, joined, mask, matches, spans

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Possessive forms of the fixed patterns: the same leftmost matches in linear time and without recursion.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Between the words of a run may be spaces, and words of brackets, points and dashes, so that a base span is never cut.
CANDIDATE = rf"(?<![^{SPACE}]){WORD}(?:\x20++(?:[().-]++\x20++)*+{WORD})*+"

ROUNDS = 3
#: A pattern needs so many instances of its kind and so high a score.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.8
#: What an unknown instance counts against a pattern, where a known one of another kind counts 1.
UNKNOWN = 0.25
#: Score from which an instance is taken.
MIN_SCORE = 0.8
NONE = "none"

SEEN = "array<struct<instance:string,start:bigint,end:bigint,kinds:array<string>,failed:boolean,patterns:array<bigint>>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_ip(match: Column) -> Column:
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    return F.forall(F.split(match, r"\."), small)


def is_card(match: Column) -> Column:
    return F.length(digits(match)).between(13, 19) & F.call_function("luhn_check", digits(match))


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


CHECKED = (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": spans(text, "email", EMAIL, may=text.contains("@")),
        "ip": spans(text, "ip", IP, is_ip, text.rlike(r"[0-9]\.[0-9]")),
        "card": spans(text, "card", CARD, is_card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": spans(text, "phone", PHONE, is_phone, text.contains("+")),
    }


def kinds_of(instance: Column) -> Column:
    """The kinds of the base spans in a candidate. No base span reaches out of one."""
    found = lambda pattern: F.regexp_extract_all(instance, F.lit(pattern), F.lit(0))
    return F.array_compact(F.array(F.when(instance.rlike(EMAIL), "email"), *[F.when(F.exists(found(p), ok), kind) for kind, p, ok in CHECKED]))


def failed(instance: Column) -> Column:
    """Whether a candidate holds what has the form of a kind and fails its check: an address out of range, or digits of a card's length."""
    digit_runs = F.regexp_extract_all(instance, F.lit(CARD), F.lit(0))
    return F.exists(F.regexp_extract_all(instance, F.lit(IP), F.lit(0)), lambda m: ~is_ip(m)) | F.exists(digit_runs, lambda m: F.length(digits(m)).between(13, 19) & ~is_card(m))


def occurrences(text: Column) -> Column:
    """Candidates with their patterns and the kinds they are known to have."""
    word = lambda w: F.when(w.contains("@"), "<id>").otherwise(F.lower(F.regexp_replace(w, "[0-9]+", "0")))
    left = rf"^[{SPACE}]*+([^{SPACE}]*+)(?:[{SPACE}]++([^{SPACE}]++))?"
    right = rf"^[{SPACE}]*+([^{SPACE}]*+)"

    def one(m: Column, end: Column, i: Column, gaps: Column) -> Column:
        back, edge = F.reverse(F.get(gaps, i)), F.when(i == 0, "<start>").otherwise("<id>")
        pick = lambda g: F.reverse(F.regexp_extract(back, left, g))
        near = F.when(pick(1) == "", edge).otherwise(word(pick(1)))
        far = F.when(pick(1) == "", "").when(pick(2) == "", edge).otherwise(word(pick(2)))
        after = F.regexp_extract(F.get(gaps, i + 1), right, 1)
        after = F.when(after == "", F.when(i + 2 < F.size(gaps), "<id>").otherwise("<end>")).otherwise(word(after))
        patterns = F.array(F.xxhash64(F.lit("left"), far, near), F.xxhash64(F.lit("around"), near, after))
        hashed = F.substring(F.sha2(m, 256), 1, 32)
        return F.struct(hashed.alias("instance"), (end - F.char_length(m)).alias("start"), end.alias("end"), kinds_of(m).alias("kinds"), failed(m).alias("failed"), patterns.alias("patterns"))

    return F.when(text.rlike("[0-9@]"), matches(text, CANDIDATE, one).cast(SEEN)).otherwise(F.array().cast(SEEN))


def scan(docs: DataFrame) -> DataFrame:
    """One narrow row per row: doc_id, key (of the text), base, seen (candidates). Written once."""
    text = text_or_empty()
    base = F.concat(*base_spans(text).values())
    return stage(docs.select("doc_id", F.xxhash64(text).alias("key"), base.alias("base"), occurrences(text).alias("seen")), "pii")


def counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def learn(occ: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(instance, kind, score) and (pattern, kind, confidence) of what is confident after the last round."""
    edges = stage(occ.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-edges")
    total = edges.count()
    of_instance, of_pattern = counted(edges, "instance"), counted(edges, "pattern")
    known = F.when(F.size("kinds") > 0, F.col("kinds")).when(F.col("failed"), F.array(F.lit(NONE)))
    seeds = stage(occ.select("instance", F.explode(known).alias("kind")).distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    scores, patterns = seeds, None
    for _ in range(rounds):
        reached = join_hot(edges, scores.join(of_instance.hint("merge"), "instance"), "instance", total)
        sums = reached.groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count_if(F.col("score") >= MIN_SCORE).alias("support"))
        best = F.max_by(F.struct("kind", "total", "support"), F.col("total")).alias("best")
        judged = sums.groupBy("pattern").agg(best, F.sum("total").alias("known")).join(of_pattern.hint("merge"), "pattern")
        confidence = F.col("best.total") / (F.col("known") + UNKNOWN * F.greatest(F.col("n") - F.col("known"), F.lit(0.0)))
        judged = judged.select("pattern", F.col("best.kind").alias("kind"), F.col("best.support").alias("support"), confidence.alias("confidence"), "n")
        patterns = stage(judged.where((F.col("kind") != NONE) & (F.col("support") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE)).drop("support"), "pii-patterns")
        found = join_hot(edges, patterns, "pattern", total).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1.001 - F.col("confidence"))))).alias("score"))
        scores = stage(seeds.unionByName(found).groupBy("instance", "kind").agg(F.max("score").alias("score")), "pii-scores")
    return scores.where((F.col("score") >= MIN_SCORE) & (F.col("kind") != NONE)), patterns.drop("n")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, key, base and added spans of each row of docs."""
    rows = scan(docs)
    occ = rows.select("doc_id", "key", F.inline("seen"))
    taken, patterns = learn(occ, rounds)
    unknown = occ.where((F.size("kinds") == 0) & ~F.col("failed")).select("doc_id", "key", "instance", "start", "end", F.explode("patterns").alias("pattern"))
    total = unknown.count()
    spoken = join_hot(unknown, patterns.join(counted(unknown, "pattern").hint("merge"), "pattern").drop("confidence"), "pattern", total).withColumnRenamed("kind", "said")
    spoken = stage(spoken.drop("pattern"), "pii-spoken")
    both = join_hot(spoken, taken.drop("score").join(counted(spoken, "instance").hint("merge"), "instance"), "instance", spoken.count()).where("kind = said")
    added = both.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    joined_rows = rows.drop("seen").join(added.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined_rows.select("doc_id", "key", "base", F.coalesce("added", F.array()).cast(SPAN).alias("added"))


def digest_columns(found: DataFrame) -> DataFrame:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    before = lambda a, b: F.when(a["kind"] != b["kind"], (rank(a) - rank(b)).cast("int")).otherwise(F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "added"), before)
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with every span replaced by its kind; n_chars, where there is such a column, follows."""
    found = find(docs, rounds)
    d, k, s = (free_name(docs, x) for x in ("doc", "key", "spans"))
    marks = found.where((F.size("base") > 0) | (F.size("added") > 0)).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.concat("base", "added").alias(s)).dropDuplicates([d, k])
    text = F.col("text")
    out = docs.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(text_or_empty()) == F.col(k)), "left")
    out = out.withColumn("text", F.when(F.col(s).isNotNull(), mask(text, F.col(s))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s).isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
