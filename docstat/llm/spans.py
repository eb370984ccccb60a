"""Matches of regular expressions as code-point spans, with DataFrame functions only.

Positions are running sums of lengths. Appending to an array copies it, so running values are worked out in blocks of BLOCK, in
blocks of blocks, and so on, and the cost stays in proportion to the matches of a text, however many these are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
LONGS = "array<bigint>"
BLOCK, LEVELS = 64, 3
#: Code points of the parts that a text is cut into before spans are masked.
PART = 4096


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short(values: Column, join) -> Column:
    return F.aggregate(values, F.array().cast(LONGS), lambda out, x: F.concat(out, F.array(let(F.try_element_at(out, F.lit(-1)), lambda last: F.when(last.isNull(), x).otherwise(join(last, x))))))


def running(values: Column, join=lambda a, b: a + b, levels: int = LEVELS) -> Column:
    """The running values, each with its own included, of an array of longs."""
    if not levels:
        return _short(values, join)

    def in_blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _short(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), join))
        return let(blocks, lambda bs: let(running(F.transform(bs, lambda b: F.element_at(b, -1)), join, levels - 1), lambda sums: shifted(bs, sums)))

    def shifted(blocks: Column, sums: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: let(F.get(sums, i - 1), lambda s: F.when(s.isNull(), b).otherwise(F.transform(b, lambda x: join(s, x))))))

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, _short(xs, join)).otherwise(in_blocks(xs)))


def matches(text: Column, pattern: str, body) -> Column:
    """body(match, end, number, gaps) of each leftmost, non-overlapping match; gaps: the texts before each match and after the last."""

    def found(gaps: Column) -> Column:
        def placed(ms: Column) -> Column:
            lengths = F.transform(ms, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("long"))
            return let(running(lengths), lambda ends: F.transform(ms, lambda m, i: body(m, F.get(ends, i), i, gaps)))

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)

    return let(F.split(text, pattern, -1), found)


def spans(text: Column, kind: str, pattern: str, keep=None, may: Column | None = None) -> Column:
    """Leftmost, non-overlapping matches of pattern in text that keep(match) accepts: kind, start, exclusive end.

    may: a cheap test that is true wherever an accepted match can be; texts that fail it are not searched.
    """
    keep = keep or (lambda match: F.lit(True))
    one = lambda m, end, i, gaps: F.when(keep(m), F.struct(F.lit(kind).alias("kind"), (end - F.char_length(m)).cast("long").alias("start"), end.cast("long").alias("end")))
    out = F.array_compact(matches(text, pattern, one)).cast(SPAN)
    return out if may is None else F.when(may, out).otherwise(F.array().cast(SPAN))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, found: Column) -> Column:
    """text with every span replaced by <KIND>; overlapping spans are replaced as one, under the kind of the first."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b, out of the parts that hold them."""
        part = lambda x: F.floor(x / PART).cast("int")
        own = F.array_join(F.slice(parts, part(a) + 1, part(b - 1) - part(a) + 1), "")
        return F.when(b > a, F.substring(own, (a % PART + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def whole(parts: Column) -> Column:
        def replaced(ss: Column) -> Column:
            def pieces(tops: Column) -> Column:
                def piece(s: Column, i: Column) -> Column:
                    at = F.coalesce(F.get(tops, i - 1), F.lit(0).cast("long"))
                    return let(at, lambda at: F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))

                return F.concat(F.array_join(F.transform(ss, piece), ""), cut(parts, F.element_at(tops, -1), F.char_length(text).cast("long")))

            return let(running(F.transform(ss, lambda s: s["end"]), F.greatest), pieces)

        return let(ordered, replaced)

    masked = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), whole)
    return F.when(F.size(found) > 0, masked).otherwise(text)
