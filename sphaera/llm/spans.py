"""Matches of a pattern with their places, as plain column expressions whose cost is linear in a text's matches.

Spark has no running fold over an array, and a fold that appends copies its output at every step.  Here values are folded
by blocks of BLOCK first; the fold before an element is that before its block and of at most BLOCK - 1 more values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:long,stop:long,text:string,before:string,after:string>"
NO_SPANS = f"array<{SPAN}>"
_SHIFT = 5
BLOCK = 1 << _SHIFT
#: Characters of a piece of a text that is cut in many places.
PIECE = 2048


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after these matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body's own lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body gets a function of an index: the fold of all values before it.  values must not be empty."""

    def blocks(v: Column) -> Column:
        last = F.shiftright(F.size(v) - 1, _SHIFT)
        each = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(v, F.shiftleft(k, _SHIFT) + 1, F.lit(BLOCK)), zero, join))
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.struct(v.alias("v"), F.aggregate(each, start, step, lambda acc: acc["out"]).alias("before"))

    def before(b: Column) -> Callable[[Column], Column]:
        return lambda i: F.aggregate(F.slice(b["v"], F.shiftleft(F.shiftright(i, _SHIFT), _SHIFT) + 1, i.bitwiseAND(F.lit(BLOCK - 1))), F.get(b["before"], F.shiftright(i, _SHIFT)), join)

    return let(values, lambda v: let(blocks(v), lambda b: body(before(b))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def running_max(values: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """The largest of the values (longs, not negative) before an index, 0 if there are none."""
    return running(values, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b), body)


def located(found: Column, between: Column, context: int = 40) -> Column:
    """Array of spans: code point start (0-based) and stop (exclusive), the match, and context characters on each side."""

    def spans(v: Column) -> Column:
        size = F.transform(v["found"], lambda hit, i: (F.length(hit) + F.length(F.get(v["between"], i))).cast("long"))

        def all_of(before: Callable[[Column], Column]) -> Column:
            def span(hit: Column, i: Column) -> Column:
                gap = F.get(v["between"], i)
                return let(before(i) + F.length(gap), lambda start: F.struct(start.cast("long").alias("start"), (start + F.length(hit)).cast("long").alias("stop"), hit.alias("text"), F.right(gap, F.lit(context)).alias("before"), F.left(F.get(v["between"], i + 1), F.lit(context)).alias("after")))

            return F.transform(v["found"], span)

        return running(size, F.lit(0).cast("long"), _plus, all_of)

    return F.when(F.size(found) > 0, let(F.struct(found.alias("found"), between.alias("between")), spans)).otherwise(F.array().cast(NO_SPANS))


def cut_out(text: Column, spans: Column, instead: Callable[[Column], Column]) -> Column:
    """text with every span (start, stop, ...; ascending, not empty) replaced; overlapping ones together, by the first's."""

    def part(pieces: Column, a: Column, z: Column) -> Column:
        """Characters a to z, from pieces of PIECE characters, so no cut counts from the text's beginning."""
        pa, pz = F.floor(a / PIECE).cast("int"), F.floor(z / PIECE).cast("int")
        at = lambda p, lo, n: F.coalesce(F.substring(F.get(pieces, p), (lo + 1).cast("int"), n.cast("int")), F.lit(""))
        across = F.concat(at(pa, a % PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, pa + 2, F.greatest(pz - pa - 1, F.lit(0))), ""), at(pz, F.lit(0), z % PIECE))
        return F.when(z <= a, F.lit("")).when(pa == pz, at(pa, a % PIECE, z - a)).otherwise(across)

    def cut(v: Column) -> Column:
        def whole(before: Callable[[Column], Column]) -> Column:
            told = F.transform(v["spans"], lambda s, i: let(before(i), lambda at: F.when(s["start"] >= at, F.concat(part(v["pieces"], at, s["start"]), instead(s))).otherwise(F.lit(""))))
            end = F.array_max(F.transform(v["spans"], lambda s: s["stop"]))
            return F.concat(F.array_join(told, ""), part(v["pieces"], end, F.greatest(v["n"], end)))

        return running_max(F.transform(v["spans"], lambda s: s["stop"]), whole)

    return let(F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).cast("long").alias("n")), cut)
