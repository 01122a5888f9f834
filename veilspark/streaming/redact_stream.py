"""Redaction of streams: the batch transforms are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.spans import explode_once
from veilspark.operators.redact import redact
from veilspark.sources import docx


def redact_stream(stream: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """A streaming table with `matches`, `n` and `redacted`."""
    return redact(stream, text_col, **options)


def counts_by_window(stream: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes", **options) -> DataFrame:
    """Matches by window and type; rows later than `late` are dropped by the watermark."""
    found = redact(stream.withWatermark(time_col, late), **options)
    return explode_once(found, "matches", "m", time_col).select(time_col, "m.type").groupBy(F.window(time_col, window), "type").agg(F.count(F.lit(1)).alias("matches"))


def watch_packages(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Redacts the packages that arrive in a folder and writes each batch as Parquet rows (path, content, redactions, regions, error)."""
    arrived = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def handle(batch: DataFrame, epoch: int) -> None:
        done = docx.redact_packages(batch.select("path", "content"), lambda spans: redact(spans, **options))
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return arrived.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
