"""Redaction of images by their words: words from a provider, boxes by the detectors, painting here.

The engine ships no OCR. A word provider gets each distinct image once; its words are an
ordinary table and the boxes come from `ocr.redaction_boxes`. What moves between tasks are words and
boxes; an image goes to one task as the first of its copies, and is painted where it lies.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import raster
from veilspark.functions.ship import ship
from veilspark.functions.text import image_cache_key, pillow_format

from .detect import Options
from .ocr import LINE, OCR_DETECTORS, redaction_boxes

WORD = ("text", "conf", "left", "top", "width", "height", *LINE)
_WORDS = f"_key string, i int, text string, conf string, {', '.join(f'{n} int' for n in WORD[2:])}, image_error string"
#: Boxes that a join may broadcast, 32 MB at most; more are joined by a shuffle, which moves images too.
MAX_BOXES = 500_000


class WordProvider(Protocol):
    def words(self, data: bytes, fmt: str) -> list[tuple[str, float, int, int, int, int, int, int, int]]:
        """Of an image its words in reading order: text, confidence of 0 to 100, left, top, width, height, and the numbers of block, paragraph and line."""


def scan_words(images: DataFrame, provider: WordProvider) -> DataFrame:
    """(_key, format, data) as words (_key, i, text, conf, left, top, width, height, block_num, par_num, line_num); an image that fails is one row with `image_error`."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, fmt, data in zip(pdf["_key"], pdf["format"], pdf["data"], strict=True):
                try:
                    rows += [(key, i, str(w[0]), str(w[1]), *map(int, w[2:]), None) for i, w in enumerate(provider.words(bytes(data), fmt))]
                except Exception as error:  # noqa: BLE001 - any failure of foreign code counts as no words, and is reported
                    rows.append((key, None, None, None, *[None] * 7, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["_key", "i", *WORD, "image_error"])

    return ship(images).select("_key", "format", "data").mapInPandas(run, _WORDS)


def painted(data: Column, fmt: Column, boxes: Column) -> Column:
    """(redacted, image_error) of images with boxes, written in the format that `fmt` names; both null where data is null."""

    @F.pandas_udf("redacted binary, image_error string")
    def run(data: pd.Series, fmt: pd.Series, boxes: pd.Series) -> pd.DataFrame:
        out = []
        for image, name, found in zip(data, fmt, boxes, strict=True):
            if image is None:
                out.append((None, None))
                continue
            try:
                picture = raster.read(bytes(image), name)
                out.append((raster.write(raster.paint(picture, [(b["left"], b["top"], b["right"], b["bottom"]) for b in found]), name), None))
            except ValueError as error:
                out.append((None, str(error)))
        return pd.DataFrame(out, columns=["redacted", "image_error"])

    return run(data, fmt, boxes)


def redact_by_words(media: DataFrame, provider: WordProvider, detectors: tuple[str, ...] = OCR_DETECTORS, options: Options = Options()) -> DataFrame:
    """media (…, format, data) with `redacted`, `regions` and `image_error`.

    Each entity found in a line of words gives one box, painted black. An image without
    boxes keeps its bytes, as does one that cannot be scanned, read or written: that one
    says so in `image_error` and has no regions. Null data stays null. Formats other than PNG and BMP
    need Pillow on the workers.
    """
    keyed = media.withColumn("_key", image_cache_key(F.coalesce("format", F.lit("")), F.col("data")))
    distinct = keyed.filter("data IS NOT NULL").groupBy("_key").agg(F.any_value("format").alias("format"), F.any_value("data").alias("data"))
    words = scan_words(distinct, provider).persist(StorageLevel.DISK_ONLY)  # read twice: a provider is slow
    box = F.struct("left", "top", "right", "bottom")
    found = redaction_boxes(words.filter("image_error IS NULL"), ["_key"], detectors, options).groupBy("_key").agg(F.collect_list(box).alias("_boxes"))
    failed = words.filter("image_error IS NOT NULL").select("_key", F.lit(None).cast(found.schema["_boxes"].dataType).alias("_boxes"), F.col("image_error").alias("_failed"))
    known = found.withColumn("_failed", F.lit(None).cast("string")).unionAll(failed).persist(StorageLevel.DISK_ONLY)
    size = known.select(F.sum(1 + F.coalesce(F.size("_boxes"), F.lit(0)))).first()[0] or 0
    joined = keyed.join(F.broadcast(known) if size <= MAX_BOXES else known, "_key", "left")
    marked = F.col("_boxes").isNotNull()
    name = pillow_format(F.col("format"))
    done = ship(joined).withColumn("_done", painted(F.when(marked, F.col("data")), name, F.col("_boxes")))
    painted_over = F.col("_done.redacted").isNotNull()
    return done.withColumns(
        {
            "redacted": F.coalesce("_done.redacted", "data"),
            "regions": F.when(painted_over, F.size("_boxes")).otherwise(0).cast("long"),
            "image_error": F.coalesce("_failed", "_done.image_error"),
        }
    ).drop("_key", "_boxes", "_failed", "_done")
