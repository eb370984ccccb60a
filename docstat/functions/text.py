"""Text and number expressions. All are native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four information separators: a class for expressions, and its characters.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What texts with white space at an end, and texts without anything else, hold.
ENDS, BLANK = rf"\A{SPACE}|{SPACE}\z", rf"\A{SPACE}*\z"
#: Characters a number may carry, and brackets that negate it.
DROPPED, BRACKETS = ",，%％", "()（）"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: What stands for no number, and the usual numbers: what is left of them without their signs is read at once.
NO_NUMBER = ("-", "—")
USUAL_NUMBER = r"^(?:[0-9][0-9,]*\.?[0-9]*[%％]?|\([0-9][0-9,]*\.?[0-9]*[%％]?\))\z"
PLAIN_NUMBER = r"^\(?-?[\d,，]+(?:\.\d+)?\)?%?$"
NUMERIC_LIKE = r"^(?U:[\s,，\-—()（）.%％]*\d[\s,，\-—()（）.%％\d]*)$"
PERIOD_MARKERS = ("本期", "上期", "本年", "上年", "期末", "期初", "报告期", "currentperiod", "previousperiod", "yearended", "asat", "2025", "2024", "2023")
UNITS = (("million", ("百万元", "百萬元", "million")), ("ten_thousand", ("万元", "萬元")), ("thousand", ("千元",)), ("yuan", ("元",)))
#: Cells of a row that expressions name one by one, which Spark compiles; it interprets the lambda functions that are left to rows of more cells.
UNROLLED = 6
CURRENCIES = (("CNY", ("人民币", "人民幣", "rmb", "cny")), ("HKD", ("港币", "港幣", "hkd")), ("USD", ("美元", "usd")))


def strip(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends; only texts that have some there are trimmed, which is dear with so many characters."""
    return F.when(text.rlike(ENDS), F.trim(text, F.lit(SPACES))).otherwise(text)


def ideographic(text: Column) -> Column:
    """Whether text starts with an ideograph (U+3400 to U+9FFF): it isn't blank then, and can't be a number. Texts are compared by their bytes, which is cheaper than any pattern."""
    return (text >= "\u3400") & (text < "\ua000")


def is_blank(text: Column) -> Column:
    """Whether text is empty or white space; null for null. Most texts tell by their first character."""
    return F.when(text == "", True).when(((text >= "!") & (text < "\x7f")) | ideographic(text), False).otherwise(text.rlike(BLANK))


def match_key(text: Column) -> Column:
    """Lower case, all white space removed, which is dear and done where there is some; null counts as empty. text is read twice: give a column, or what `let` worked out."""
    return F.lower(F.when(text.rlike(SPACE), F.translate(text, SPACES, "")).otherwise(F.coalesce(text, F.lit(""))))


def contains_any(text: Column, words) -> Column:
    """Whether text holds one of the words; one pass over it for all of them."""
    return text.rlike("|".join(re.escape(w) for w in words))


def _cased(c: str) -> str:
    """A lower-case character in any case; of other than ASCII letters only the Kelvin sign becomes one in lower case."""
    return "[kK\u212a]" if c == "k" else f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)


def in_any_case(words) -> str:
    """A pattern that a text has where it has one of the words, which are in lower case, after it is lowered."""
    return "|".join("".join(map(_cased, w)) for w in words)


def spaced(words) -> str:
    """A pattern that a text has where its key (`match_key`) has one of the words, which are keys themselves: in any case, with white space between any characters."""
    return "|".join(f"{SPACE}*".join(map(_cased, w)) for w in words)


def first_label(text: Column, labelled, default: str = "unknown") -> Column:
    """The label of the first entry one of whose words text holds; text is worked out once, also where the label ends in a filter."""

    def label_of(whole: Column) -> Column:
        out = F
        for label, words in labelled:
            out = out.when(contains_any(whole, words), label)
        return out.otherwise(default)

    return let(text, label_of)


def first_in_any_case(text: Column, labelled, default: str = "unknown") -> Column:
    """The label of the first entry one of whose words, in lower case, the text holds in any case."""
    out = F
    for label, words in labelled:
        out = out.when(text.rlike(in_any_case(words)), label)
    return out.otherwise(default)


def each(items: Column, body) -> Column:
    """body of each item of an array."""
    few = F.array(*[F.when(F.size(items) > i, body(F.get(items, F.lit(i)))) for i in range(UNROLLED)])
    return F.when(F.size(items) <= UNROLLED, F.slice(few, F.lit(1), F.size(items))).otherwise(F.transform(items, body))


def count_of(items: Column, holds) -> Column:
    """How many items of an array it holds for."""
    few = sum((F.when((F.size(items) > i) & holds(F.get(items, F.lit(i))), 1).otherwise(0) for i in range(1, UNROLLED)), F.when((F.size(items) > 0) & holds(F.get(items, F.lit(0))), 1).otherwise(0))
    return F.when(F.size(items) <= UNROLLED, few).otherwise(F.size(F.filter(items, holds)))


def places_of(items: Column, holds, start: int = 0) -> tuple[Column, Column]:
    """The first and the last place from start on, of an array, whose item it holds for; null where there is none."""
    few = [F.when((F.size(items) > i) & holds(F.get(items, F.lit(i))), i) for i in range(start, UNROLLED)]
    many = F.filter(F.sequence(F.lit(start), F.size(items) - 1), lambda i: holds(F.get(items, i)))
    small = F.size(items) <= UNROLLED
    return F.when(small, F.coalesce(*few)).otherwise(F.array_min(many)), F.when(small, F.coalesce(*reversed(few))).otherwise(F.array_max(many))


def join_each(items: Column, body, facts: Column, by: str) -> Column:
    """The texts that body makes of each item and what facts, an array as long, has at its place, joined; null is left out."""
    few = F.concat_ws(by, *[F.when(F.size(items) > i, body(F.get(items, F.lit(i)), F.get(facts, F.lit(i)))) for i in range(UNROLLED)])
    return F.when(F.size(items) <= UNROLLED, few).otherwise(F.array_join(F.zip_with(items, facts, body), by))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _usual_number(raw: Column) -> Column:
    return F.replace(F.trim(raw, F.lit("()%％")), F.lit(",")).try_cast("double") * F.when(raw.startswith("("), -1).otherwise(1)


def _odd_number(raw: Column) -> Column:
    def number(bare: Column) -> Column:
        return F.when(bare.rlike(NUMBER), F.regexp_replace(bare, r"(?i)^[+-]?nan$", "nan").try_cast("double"))

    def signed(text: Column) -> Column:
        negative = (text.startswith("(") & text.endswith(")")) | (text.startswith("（") & text.endswith("）"))
        bare = F.translate(strip(F.trim(text, F.lit(BRACKETS))), WIDE_DIGITS, DIGITS)
        return let(F.regexp_replace(bare, "(?<=[0-9])_(?=[0-9])", ""), number) * F.when(negative, -1).otherwise(1)

    shown = F.when(F.coalesce(raw, F.lit("")).rlike(r"(?U)\d|(?i:inf|nan)"), F.translate(strip(raw), DROPPED, ""))
    return let(shown, signed)


def parse_number(raw: Column) -> Column:
    """A double, or null: separators and percent signs dropped, brackets around it negate."""
    return F.when((raw == "") | ideographic(raw), None).when(raw.rlike(USUAL_NUMBER), _usual_number(raw)).otherwise(_odd_number(raw))


def cell_facts(raw: Column) -> Column:
    """(number, numeric, blank): parse_number, is_numeric_like and is_blank of a cell at once, so that most cells meet one pattern or none."""
    facts = lambda number, numeric, blank: F.struct(F.lit(number).cast("double").alias("number"), F.lit(numeric).alias("numeric"), F.lit(blank).alias("blank"))
    plain = F.when(raw == "", facts(None, False, True)).when(ideographic(raw) | raw.isin(*NO_NUMBER), facts(None, False, False))
    return plain.when(raw.rlike(USUAL_NUMBER), facts(_usual_number(raw), True, False)).otherwise(facts(_odd_number(raw), is_numeric_like(raw), is_blank(raw)))


def is_numeric_like(text: Column) -> Column:
    """Only digits and number signs, with at least one digit."""
    lettered = (text == "") | ((text >= ":") & (text < "\x7f")) | ideographic(text)
    return F.when(lettered, False).otherwise(F.coalesce(text, F.lit("")).rlike(NUMERIC_LIKE))


def is_suspicious(raw: Column, value_type: Column, value: Column) -> Column:
    number = value_type == "number"

    def shown(text: Column) -> Column:
        odd = ~F.replace(text, F.lit(" "), F.lit("")).rlike(PLAIN_NUMBER)
        return (text == "") | (text.contains("\n") & (F.length(text) <= 4)) | (number & (value.isNull() | odd))

    return F.when(raw.rlike(PLAIN_NUMBER), number & value.isNull()).otherwise(let(strip(F.coalesce(raw, F.lit(""))), shown))


def looks_broken(raw: Column, value: Column) -> Column:
    text = strip(F.coalesce(raw, F.lit("")))
    return (text == "") | (text.contains("\n") & (F.length(text) <= 4)) | (value.isNull() & F.coalesce(raw, F.lit("")).rlike(r"(?U)\d"))


def looks_like_period(key: Column, markers=PERIOD_MARKERS) -> Column:
    return contains_any(key, markers)


def _first_spaced(text: Column, labelled) -> Column:
    out = F
    for label, words in labelled:
        out = out.when(text.rlike(spaced(words)), label)
    return out.otherwise("unknown")


def unit_of(text: Column) -> Column:
    """The unit that a text, or its key, tells."""
    return _first_spaced(text, UNITS)


def currency_of(text: Column) -> Column:
    return _first_spaced(text, CURRENCIES)


def quoted_list(items: Column) -> Column:
    """An array of strings as a bracketed list of quoted items."""
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def reasons(*pairs) -> Column:
    """The texts of the (condition, text) pairs that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def document_id(path: Column, task_id: Column) -> Column:
    return F.concat(F.lit("parsed_doc_"), F.substring(F.sha1(F.concat_ws("|", path, task_id)), 1, 16))


def decision_id(document: Column) -> Column:
    return F.concat(F.lit("parse_review_decision_"), F.substring(F.sha1(document), 1, 16))


def clamp_score(score: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 4)


def fixed(value: Column, places: int) -> Column:
    """With so many decimals, ties to even; format_string alone rounds ties up."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
