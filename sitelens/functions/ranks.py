"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_SPAN = 100_000


def ranked(rows: DataFrame, keys: list[str], order: str = "row_no", ties: str = "") -> DataFrame:
    """Adds ``rank`` (from 0) and ``total`` within ``keys``, by the number ``order`` and, among equal ones, ``ties``.

    Rows are numbered inside spans of ``order`` and shifted by the counts of the spans before,
    so a group of any size is spread over many tasks.
    """
    spanned = rows.withColumn("span", F.floor(F.col(order) / RANK_SPAN))
    k, by = ", ".join(keys), f"{order}, {ties}" if ties else order
    counts = spanned.groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*keys, "span", F.expr(f"sum(n) over (partition by {k} order by span) - n").alias("before"), F.expr(f"sum(n) over (partition by {k})").alias("total"))
    local = spanned.withColumn("local", F.expr(f"row_number() over (partition by {k}, span order by {by}) - 1"))
    return local.join(offsets, [*keys, "span"]).withColumn("rank", F.col("before") + F.col("local")).drop("span", "local", "before")
