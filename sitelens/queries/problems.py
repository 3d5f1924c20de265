"""Queries of the general data-processing problems (core part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.orphans import audit_references, orphans
from sitelens.operators.packed_values import lattice_report, split_packed
from sitelens.session import table

PACKED = ["redirect_chain", "ld_types", "hreflang", "resource_paths"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value packed in the four list cells of crawl."""
    return split_packed(table(spark, sf_dir, "crawl", "row_no", *PACKED), "row_no", PACKED)


def p1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: cells, atoms, values, and cells in which the lattice had a choice."""
    return lattice_report(table(spark, sf_dir, "crawl", *PACKED), PACKED)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*audit_references(*(table(spark, sf_dir, t) for t in ("judge", "findings", "affected_urls", "rule_registry"))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of judge, findings and affected_urls."""
    return _orphans(spark, sf_dir).select("src_table", "src_key", "src_item", "ref_key")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    month = F.when(F.col("period") >= 0, F.format_string("%04d-%02d", F.floor(F.col("period") / 12), F.col("period") % 12 + 1)).otherwise("")
    return _orphans(spark, sf_dir).groupBy("src_table", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_key").alias("missing_keys"))


_P4_SQL = """
WITH f AS (SELECT run_key, fixture, run_no, produced_at, unnest(s.findings) AS f
           FROM (SELECT run_key, fixture, run_no, produced_at, unnest(sections) AS s FROM findings)),
rules AS (SELECT lower(regexp_replace(rule_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS rk, introduced_at AS a, retired_at AS b FROM rule_registry),
rr AS (
  SELECT 'findings' AS src_table, run_key AS src_key, coalesce(f.id, '') AS src_item, unnest(f.rule_ids) AS r, produced_at AS t FROM f
  UNION ALL SELECT 'affected_urls', hit_no, '', rule_id, logged_at FROM affected_urls),
r AS (SELECT src_table, src_key, src_item, lower(regexp_replace(r, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS ref_key, t FROM rr),
j AS (SELECT verdict_key, fixture, run_no, lower(regexp_replace(finding_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS ref_key, judged_at AS t FROM judge),
o AS (
  SELECT DISTINCT src_table, src_key, src_item, ref_key, t FROM r
  WHERE ref_key <> '' AND NOT EXISTS (SELECT 1 FROM rules WHERE rk = ref_key AND a <= t AND (b IS NULL OR t < b))
  UNION
  SELECT DISTINCT 'judge', verdict_key, '', ref_key, t FROM j
  WHERE ref_key <> '' AND NOT EXISTS (
    SELECT 1 FROM f WHERE f.fixture = j.fixture AND f.run_no = j.run_no AND lower(regexp_replace(f.f.id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) = j.ref_key
      AND f.produced_at <= j.t AND (f.f.deleted_at IS NULL OR j.t < f.f.deleted_at)))
"""

QUERIES = {"p1_found": p1_found, "p1_lattice": p1_lattice, "p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _P4_SQL + "SELECT DISTINCT src_table, src_key, src_item, ref_key FROM o",
    "p4_report": _P4_SQL + "SELECT src_table, strftime(t, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT ref_key) AS missing_keys FROM o GROUP BY 1, 2",
}
