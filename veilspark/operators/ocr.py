"""Redaction boxes from tables of OCR words.

Words have (i, text, conf, left, top, width, height, block_num, par_num, line_num) and the
columns that tell images apart. An image's line is the unit that is gathered, once: its
entities and their boxes come from its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.spans import explode_once, let

from .detect import Options, detect_all
from .resolve import resolve_overlaps

LINE = ("block_num", "par_num", "line_num")
MIN_CONFIDENCE = 30.0
#: The structured types and pattern recognisers that images are searched for; birth dates are not.
OCR_DETECTORS = ("email", "phone", "ssn", "credit_card", "ipv4", "ipv6", "org_suffix", "address_us", "address_in_locality", "address_in_house", "address_in_pin")


def confident_words(words: DataFrame, least: float = MIN_CONFIDENCE, options: Options = Options()) -> DataFrame:
    """Words with text, stripped, and a confidence of at least `least`; an unreadable confidence is -1. With `options.ascii_classes` only ASCII spaces are stripped."""
    text = F.regexp_replace(F.col("text"), rf"^{P.S}+|{P.S}+\z" if options.ascii_classes else r"(?U)^\s+|\s+$", "")
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double"), F.lit(-1.0))
    return words.withColumns({"text": text, "conf": conf}).filter((F.col("text") != "") & (F.col("conf") >= least))


def word_spans(words: DataFrame, image: list[str]) -> DataFrame:
    """Adds `start` and `end` of each word in its line's text, where words are joined by a space."""
    before = Window.partitionBy(*image, *LINE).orderBy("i", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return words.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def lines(words: DataFrame, image: list[str]) -> DataFrame:
    """One row a line: its text, and the place of its first word."""
    parts = F.array_sort(F.collect_list(F.struct("i", "text")))
    return words.groupBy(*image, *LINE).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("line_text"), F.min("i").alias("first_i"))


def entities(line_rows: DataFrame, image: list[str], detectors: tuple[str, ...] = OCR_DETECTORS, options: Options = Options()) -> DataFrame:
    """One row an entity of a line: type, entity_start, entity_end, value."""
    found = line_rows.withColumn("matches", resolve_overlaps(detect_all(F.col("line_text"), detectors, options)))
    return explode_once(found, "matches", "m", *image, *LINE).select(*image, *LINE, F.col("m.type").alias("type"), F.col("m.start").alias("entity_start"), F.col("m.end").alias("entity_end"), F.col("m.value").alias("value"))


def overlapping(spans: DataFrame, found: DataFrame, image: list[str]) -> DataFrame:
    """Words joined with the entities of their line that they overlap."""
    return spans.join(found, [*image, *LINE]).filter((F.col("start") < F.col("entity_end")) & (F.col("end") > F.col("entity_start")))


def boxes(pairs: DataFrame, image: list[str]) -> DataFrame:
    """The union of the word boxes of each entity; boxes of different entities stay apart."""
    far = lambda a, b: F.max(F.col(a) + F.col(b)).cast("long")
    return pairs.groupBy(*image, *LINE, "type", "entity_start", "entity_end").agg(
        F.min("left").cast("long").alias("left"), F.min("top").cast("long").alias("top"), far("left", "width").alias("right"), far("top", "height").alias("bottom")
    )


def redaction_boxes(words: DataFrame, image: list[str], detectors: tuple[str, ...] = OCR_DETECTORS, options: Options = Options()) -> DataFrame:
    """From raw words to the boxes to paint, as `boxes` of `overlapping` would give them, with one shuffle and no join. Lines with a null among their keys count as any other."""
    keys = [*image, *LINE]
    edges = {"left": F.col("left"), "top": F.col("top"), "right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")}
    word = F.struct("i", "text", "start", "end", *(e.cast("long").alias(n) for n, e in edges.items()))
    gathered = F.array_sort(F.collect_list(word))
    rows = word_spans(confident_words(words, options=options), image).groupBy(*keys).agg(gathered.alias("_words"), F.array_join(F.transform(gathered, lambda w: w["text"]), " ").alias("line_text"))
    found = rows.withColumn("matches", resolve_overlaps(detect_all(F.col("line_text"), detectors, options)))

    def box(m: Column) -> Column:
        hit = F.filter("_words", lambda w: (w["start"] < m["end"]) & (w["end"] > m["start"]))
        edge = lambda hit, n: (F.array_min if n in ("left", "top") else F.array_max)(F.transform(hit, lambda w: w[n])).alias(n)
        return let(hit, lambda hit: F.struct(m["type"].alias("type"), m["start"].alias("entity_start"), m["end"].alias("entity_end"), *(edge(hit, n) for n in edges)))

    return explode_once(found, F.transform("matches", box), "b", *keys).select(*keys, "b.*")


def box_count(found: DataFrame, image: list[str]) -> DataFrame:
    return found.groupBy(*image).agg(F.count(F.lit(1)).alias("regions"))


