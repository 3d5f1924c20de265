"""Incremental audits: page batches arrive as files and are checked as they come (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.plans.audit import page_hits


def audit_stream(spark: SparkSession, source: str, schema, hits_path: str, checkpoint: str, watermark: str = "7 days"):
    """Starts a query that reads new crawl files under ``source``, drops pages fetched twice within the
    watermark, and appends the hits of the page rules to ``hits_path``; ends when all files are read."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["host", "url"])
    return page_hits(rows).writeStream.format("parquet").option("path", hits_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def resume_state(fetched: DataFrame, frontier: DataFrame) -> DataFrame:
    """What an interrupted crawl still has to fetch: the frontier without the pages that are there."""
    return frontier.join(fetched.select("site", "url").distinct(), ["site", "url"], "left_anti")
