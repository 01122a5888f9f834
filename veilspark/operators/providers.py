"""Providers of model-based entities and of OCR, and deduplication of their work.

The engine ships no models: names of people and companies by context, OCR and painting
come from providers. Without one, the no-op provider finds nothing and images stay as
they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.ship import ship

from .detect import MATCH, priority_of

ENTITIES = "array<struct<type:string,start:bigint,end:bigint,text:string,confidence:double>>"


class TextProvider(Protocol):
    def analyze(self, texts: list[str]) -> list[list[tuple[str, int, int, str, float]]]:
        """Of each text its entities (type, start, end, text, confidence), in code points."""


class ImageProvider(Protocol):
    def redact_image(self, data: bytes, fmt: str) -> tuple[bytes, int]:
        """(image, regions painted); the same bytes if there is nothing to hide."""


class NoOp:
    """Finds nothing."""

    def analyze(self, texts: list[str]) -> list[list[tuple[str, int, int, str, float]]]:
        return [[] for _ in texts]

    def redact_image(self, data: bytes, fmt: str) -> tuple[bytes, int]:
        return data, 0


def dedup_by_text(rows: DataFrame, column: str, work: Callable[[DataFrame], DataFrame], count_as: str | None = None) -> DataFrame:
    """Does `work` once for each distinct text and joins the results back.

    `work` gets a table with the text column alone and adds columns. Texts are matched by
    digest, so the join's keys are small; null texts keep null results.
    """
    keyed = rows.withColumn("_digest", F.sha2(column, 256))
    counted = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    distinct = keyed.filter(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.any_value(column).alias(column), *counted)
    done = work(distinct)
    new = [c for c in done.columns if c not in (column, "_digest")]
    return keyed.join(done.select("_digest", *new), "_digest", "left").drop("_digest")


def entities(rows: DataFrame, column: str, provider: TextProvider) -> DataFrame:
    """Adds `entities` and `provider_error`. The provider gets a batch of distinct texts at a time, without empty ones; where that fails, each by itself, and an error leaves that text without entities and says so."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        names = ("type", "start", "end", "text", "confidence")
        told = lambda es: [dict(zip(names, e, strict=True)) for e in es]
        for pdf in batches:
            texts = list(pdf[column])
            at = [i for i, text in enumerate(texts) if text]
            found, errors = [[] for _ in texts], [None] * len(texts)
            try:
                every = [told(es) for es in provider.analyze([texts[i] for i in at])] if at else []
                for i, es in zip(at, every, strict=True):
                    found[i] = es
            except Exception:  # noqa: BLE001 - one text at a time tells which fails; any failure of foreign code counts as no entities
                for i in at:
                    try:
                        found[i] = told(provider.analyze([texts[i]])[0])
                    except Exception as error:  # noqa: BLE001
                        found[i], errors[i] = [], f"{type(error).__name__}: {error}"
            yield pdf.assign(entities=found, provider_error=errors)

    def work(distinct: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{n}` {t}" for n, t in distinct.dtypes)
        return ship(distinct).mapInPandas(run, f"{kinds}, entities {ENTITIES}, provider_error string")

    return dedup_by_text(rows, column, work)


def detector(kind: str, find: Callable[[str], Iterable[tuple[int, int]]]) -> Callable[[Column], Column]:
    """A detector written in Python: from a text column to (matches, error).

    `find` tells the (start, end) of its matches in a text, in code points. Where it fails that
    text has no match of this kind and says why in `error`; other detectors go on. Null text has no
    matches. Put the result in a column, and give its `matches` to `redact` as `extra`.
    """
    priority = priority_of(kind)
    names = ("start", "neg_length", "priority", "type", "end", "value")

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                spans = [(int(a), int(b)) for a, b in find(text)] if text is not None else []
                if any(not 0 <= a < b <= len(text) for a, b in spans):
                    raise ValueError("a span lies outside the text")
                out.append(([dict(zip(names, (a, a - b, priority, kind, b, text[a:b]), strict=True)) for a, b in spans], None))
            except Exception as error:  # noqa: BLE001 - any failure of foreign code counts as no match, and is reported
                out.append(([], f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["matches", "error"])

    return F.pandas_udf(run, f"matches array<{MATCH}>, error string")


def redact_images(media: DataFrame, provider: ImageProvider) -> DataFrame:
    """media (…, format, data) with `redacted`, `regions` and `image_error`; equal images of a format are looked at once. A failure keeps the image."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, fmt in zip(pdf["data"], pdf["format"], strict=True):
                try:
                    out.append((*provider.redact_image(bytes(data), fmt), None))
                except Exception as error:  # noqa: BLE001 - the image stays, and the error is reported
                    out.append((bytes(data), 0, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame({"_key": pdf["_key"], "redacted": [o[0] for o in out], "regions": [o[1] for o in out], "image_error": [o[2] for o in out]})

    keyed = media.withColumn("_key", F.concat_ws(":", "format", F.sha2("data", 256)))
    distinct = keyed.groupBy("_key").agg(F.any_value("format").alias("format"), F.any_value("data").alias("data"))
    return keyed.join(ship(distinct).mapInPandas(run, "_key string, redacted binary, regions long, image_error string"), "_key", "left").drop("_key")
