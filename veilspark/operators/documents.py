"""Package parts as rows: replacement by a left join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replaced_parts(parts: DataFrame, changed: DataFrame) -> DataFrame:
    """Every part of (doc_id, name, content), with the content of `changed` (same columns) where it has one, and `replaced`. A part that occurs twice in `changed` is an error of its maker: it repeats here."""
    new = changed.select("doc_id", "name", F.col("content").alias("_new"))
    joined = parts.join(new, ["doc_id", "name"], "left")
    return joined.select(*[c for c in parts.columns if c != "content"], F.coalesce("_new", "content").alias("content"), F.col("_new").isNotNull().alias("replaced"))
