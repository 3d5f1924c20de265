"""Search performance exports: the window that a request covers, and its rows as a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Days that a report covers, days until figures are complete, rows of a request, its dimensions.
WINDOW_DAYS, LAG_DAYS, ROW_LIMIT, DIMENSIONS = 28, 3, 1000, ("query", "page")
SCHEMA = "available boolean, property string, reason string, rows array<struct<keys array<string>, clicks double, impressions double, ctr double, position double>>"


def window(today: dt.date) -> tuple[str, str]:
    """First and last day of the report that is complete on ``today``."""
    last = today - dt.timedelta(days=LAG_DAYS)
    return (last - dt.timedelta(days=WINDOW_DAYS)).isoformat(), last.isoformat()


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(property, query, page, clicks, impressions, ctr, position) of exported answers; an answer that is not
    available gives no rows."""
    answers = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = answers.where(F.coalesce("available", F.lit(True))).select("property", F.explode("rows").alias("r"))
    key = lambda i: F.try_element_at("r.keys", F.lit(i + 1)).alias(DIMENSIONS[i])
    return rows.select("property", key(0), key(1), F.col("r.clicks").cast("bigint").alias("clicks"), F.col("r.impressions").cast("bigint").alias("impressions"), "r.ctr", "r.position")


def per_page(rows: DataFrame) -> DataFrame:
    """(property, page, clicks, impressions, ctr, position): queries of a page together, positions by impressions."""
    out = rows.groupBy("property", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("weighted"))
    share = lambda a: F.when(F.col("impressions") > 0, F.col(a) / F.col("impressions"))
    return out.select("property", "page", "clicks", "impressions", share("clicks").alias("ctr"), share("weighted").alias("position"))
