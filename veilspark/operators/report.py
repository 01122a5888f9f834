"""Counts and quality figures of a redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import explode_once


def counts_by_type(redacted: DataFrame, key: str) -> DataFrame:
    """type, matches, texts from a table with `matches`."""
    rows = explode_once(redacted, "matches", "m", key).select(key, "m.type")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(key).alias("texts"))


def totals(redacted: DataFrame, *by: str) -> DataFrame:
    """Matches and texts with any, over all rows or by the columns given."""
    return redacted.groupBy(*by).agg(F.sum("n").alias("matches"), F.sum((F.col("n") > 0).cast("long")).alias("texts"))


def totals_rollup(redacted: DataFrame, *by: str) -> DataFrame:
    """`totals` with subtotals; a null key stands for all."""
    return redacted.rollup(*by).agg(F.sum("n").alias("matches"), F.sum((F.col("n") > 0).cast("long")).alias("texts"))


def calls(texts: DataFrame, column: str) -> DataFrame:
    """Rows, and the distinct texts that a deduplicated analysis looks at."""
    return texts.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(column).alias("distinct_texts"))


def evaluate(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall; a ratio without cases is null."""
    t, f = F.col(truth), F.col(found)
    counted = rows.agg(*(F.count_if(c).alias(n) for n, c in (("tp", t & f), ("fp", ~t & f), ("fn", t & ~f), ("tn", ~t & ~f))))
    ratio = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    return counted.select("*", ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"), ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"))
