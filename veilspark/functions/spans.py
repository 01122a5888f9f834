"""Regex matches with their places, as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that one fold adds up; more are added up block by block, so the cost of n matches stays near n.
_BLOCK = 64
_SPANS = "array<struct<value:string,start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _fold(pairs: Column, base: Column) -> Column:
    """Spans of an array of (value, gap before it) that begins at offset `base`."""
    zero = F.struct(base.alias("at"), _empty(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["value"].alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def in_blocks(items: Column) -> Column:
    """An array in parts of `_BLOCK` elements, or as many as there are parts if those are more; it must not be empty."""
    size = F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda b: F.slice(items, b * n + 1, n)))


def _by_blocks(pairs: Column) -> Column:
    cut = in_blocks(pairs)
    zero = F.struct(F.lit(0).cast("long").alias("at"), _empty("array<bigint>").alias("bases"))
    length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, m: n + m["gap"] + F.length(m["value"]))
    step = lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))
    return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.aggregate(blocks, zero, step, lambda acc: acc["bases"]), _fold)))


def match_pairs(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<value:string,gap:bigint>>: the matches of `match_spans`, each with the characters between it and the one before."""
    kind = "array<struct<value:string,gap:bigint>>"

    def paired(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        return F.when(F.size(found) == 0, _empty(kind)).otherwise(pairs)

    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)
    return F.when(text.isNotNull() if guard is None else guard, pairs).otherwise(_empty(kind))


def placed(pairs: Column) -> Column:
    """array<struct<value:string,start:bigint,end:bigint>> from `match_pairs`; `pairs` is used several times, so it should be a column or a lambda's variable."""
    return F.when(F.size(pairs) == 0, _empty(_SPANS)).when(F.size(pairs) <= _BLOCK, _fold(pairs, F.lit(0).cast("long"))).otherwise(_by_blocks(pairs))


def match_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<value:string,start:bigint,end:bigint>> of the leftmost non-overlapping matches of a Java pattern.

    Offsets are code points, end exclusive. Null text gives an empty array. The pattern must
    not match the empty string. `guard` is a cheap condition that every text with a match meets.
    """
    return let(match_pairs(text, pattern, guard), placed)


def match_context(text: Column, pattern: str, width: int, guard: Column | None = None) -> Column:
    """array<struct<before:string,after:string>> parallel to `match_spans`: up to `width` characters on either side, between the neighbouring matches."""
    kind = "array<struct<before:string,after:string>>"

    def sides(gaps: Column) -> Column:
        side = lambda i: F.struct(F.right(F.get(gaps, i - 1), F.lit(width)).alias("before"), F.left(F.get(gaps, i), F.lit(width)).alias("after"))
        return F.when(F.size(gaps) < 2, _empty(kind)).otherwise(F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), side))

    return F.when(text.isNotNull() if guard is None else guard, let(F.split(text, pattern, -1), sides)).otherwise(_empty(kind))


def explode_once(df: DataFrame, array: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """A row for each element. Unlike a plain explode this gives the optimizer no reason to filter by the array's size first, which would make a computed array several times."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def disjoint(items: Column, kind: str) -> Column:
    """Of a sorted array of structs of type `kind` with `start` and `end`, those that begin at or after the end of the last one kept. Folds run over a block at a time, so n elements cost about n."""
    nothing = lambda of: F.expr(f"cast(array() as {of})")

    def step(acc: Column, m: Column) -> Column:
        fits = m["start"] >= acc["last"]
        return F.struct(F.when(fits, m["end"]).otherwise(acc["last"]).alias("last"), F.when(fits, F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"))

    def inner(block: Column, last: Column) -> Column:
        return F.aggregate(block, F.struct(last.alias("last"), nothing(f"array<{kind}>").alias("kept")), step)

    def outer(acc: Column, block: Column) -> Column:
        joined = lambda x: F.struct(x["last"].alias("last"), F.concat(acc["kept"], F.array(x["kept"])).alias("kept"))
        return let(inner(block, acc["last"]), joined)

    first = F.lit(-1).cast("long")
    long = F.flatten(F.aggregate(in_blocks(items), F.struct(first.alias("last"), nothing(f"array<array<{kind}>>").alias("kept")), outer, lambda acc: acc["kept"]))
    return F.when(F.size(items) <= 1, items).when(F.size(items) <= _BLOCK, inner(items, first)["kept"]).otherwise(long)


def splice(text: Column, items: Column) -> Column:
    """`text` with each (start, end, replacement) of a sorted, disjoint array put in. The text is cut once a block of replacements and then only within the block's part, so n of them cost about n."""
    zero = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def part(own: Column, base: Column, block: Column) -> Column:
        """`own`, the text from `base` to the end of the block's last item, with the block's items."""

        def step(acc: Column, r: Column) -> Column:
            gap = F.substring(own, (acc["at"] - base + 1).cast("int"), (r["start"] - acc["at"]).cast("int"))
            return F.struct(r["end"].alias("at"), F.concat(acc["parts"], F.array(gap, r["replacement"])).alias("parts"))

        return F.aggregate(block, zero(base), step, lambda acc: F.array_join(acc["parts"], ""))

    def outer(acc: Column, block: Column) -> Column:
        end = F.element_at(block, -1)["end"]
        own = F.substring(text, (acc["at"] + 1).cast("int"), (end - acc["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(acc["parts"], F.array(let(own, lambda o: part(o, acc["at"], block)))).alias("parts"))

    tail = lambda at: F.substring(text, (at + 1).cast("int"), F.length(text))
    start = F.lit(0).cast("long")
    whole = F.aggregate(in_blocks(items), zero(start), outer, lambda acc: F.concat(F.array_join(acc["parts"], ""), tail(acc["at"])))
    short = F.concat(part(text, start, items), tail(F.element_at(items, -1)["end"]))
    return F.when(F.size(items) == 0, text).when(F.size(items) <= _BLOCK, short).otherwise(whole)
