"""Redaction of a text column: detect, resolve, fake, splice; one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fake as fakes

from .detect import Options, detect_all
from .resolve import apply, resolve_overlaps


def replacements(matches: Column, salt: str = "", generators: dict = fakes.GENERATORS) -> Column:
    """Resolved matches with their `replacement`."""
    return F.transform(matches, lambda m: m.withField("replacement", fakes.fake(m["type"], m["value"], salt, generators)))


def redact(
    df: DataFrame, text_col: str = "text", detectors: tuple[str, ...] | None = None, options: Options = Options(), salt: str = "",
    generators: dict = fakes.GENERATORS, extra: tuple[Column, ...] = (),
) -> DataFrame:
    """`df` with `matches`, `n` and `redacted`.

    Null text has no matches and null `redacted`; a text without matches comes back as it
    is. The projections are separate so that each list is made once.
    """
    text = F.col(text_col)
    found = df.withColumn("matches", resolve_overlaps(detect_all(text, detectors, options, extra)))
    return found.withColumn("n", F.size("matches").cast("long")).withColumn(
        "redacted", F.when(F.col("n") == 0, text).otherwise(apply(text, replacements(F.col("matches"), salt, generators)))
    )
