"""Readers and writers of the audit's files: crawl CSV, JSON documents, affected-URL lists, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.ranks import ranked

# The columns of a crawl, in the order of its CSV file; all cells are strings and '' is absent.
CRAWL_COLUMNS = [
    "url", "page_type", "status", "final_url", "redirected", "redirect_chain",
    "title", "title_len", "meta_desc", "meta_desc_len", "meta_missing", "canonical", "canon_self", "robots_meta", "html_lang", "hreflang_count", "hreflang", "h1", "h1_count", "heading_outline",
    "ld_types", "ld_valid", "ld_context_ok", "has_product", "has_agg", "has_breadcrumb", "has_org", "has_org_same_as", "has_faq", "has_author", "date_published", "date_modified", "offer_price",
    "availability", "img_total", "img_no_alt", "img_jpg", "img_webp", "img_avif", "outlinks_internal", "outlinks_authoritative", "word_count", "raw_word_count", "https_ok", "mixed_content",
    "error_code", "viewport_content", "charset_ok", "og_title", "og_image", "og_url", "has_favicon", "canonical_count", "img_no_dimensions", "first_img_lazy", "dom_node_count",
    "head_blocking_scripts", "head_blocking_styles", "generic_anchor_count", "empty_link_count", "unlabeled_control_count", "agg_rating_value", "agg_rating_count",
    "has_shipping_details", "has_return_policy", "has_org_logo", "has_org_contact_point", "x_robots_tag", "hsts_present", "frame_protection", "content_encoding", "hreflang_links",
    "nosniff_present", "referrer_policy_present", "permissions_policy_present", "csp_present", "cookie_insecure", "version_disclosure", "has_microdata", "has_rdfa", "resource_paths",
    "outlinks_external",
]
# Limits of the crawl profiles.
PROFILES = {
    "quick": {"max_urls": 50, "max_depth": 2, "rps": 2.0, "workers": 1},
    "standard": {"max_urls": 300, "max_depth": 4, "rps": 2.0, "workers": 2},
    "full": {"max_urls": 25_000, "max_depth": 8, "rps": 3.0, "workers": 4},
}


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 with header; quotes are doubled, nulls become empty. Committed as a whole."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a crawl CSV, all strings; the header is skipped, the order of columns counts, empty is ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.fillna("")


FINDINGS_SCHEMA = (
    "meta struct<url: string, sampleSize: int, siteType: string, rulesetVersion: string, coveragePct: int>, "
    "sections array<struct<id: string, num: int, title: string, findings: array<struct<id: string, title: string, category: string, severity: string, prov: string, befund: string, beleg: string, "
    "evidence: string, auswirkung: string, empfehlung: string, ice: struct<i: int, c: int, e: int, score: int>, kbSources: array<struct<source: string, heading: string, date: string>>, ruleIds: array<string>>>>>, "
    "positives array<string>, confidence struct<sampleSize: int, minNMet: boolean, caveats: array<string>>"
)
VERDICT_SCHEMA = "fixture string, run int, judgeModel string, promptVersion string, verdicts array<struct<findingId: string, supported: boolean, provenanceCorrect: boolean, fabricatedNumbers: boolean, verdict: string, rationale: string>>"
RUN_PATH = r"/([^/]+)/run-(\d+)/[^/]*$"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a given schema, one row each, with the fixture and run of their path."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    file = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(file, RUN_PATH, 1).alias("path_fixture"), F.regexp_extract(file, RUN_PATH, 2).try_cast("int").alias("path_run"))


def write_affected(hits: DataFrame, path: str) -> None:
    """``rule_id,url`` lines."""
    hits.select(F.concat_ws(",", "rule_id", "url").alias("value")).write.mode("overwrite").text(path)


def read_affected(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, url) of ``rule_id,url`` lines; only the first comma separates, a header line is skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND value NOT RLIKE '^(ruleId|rule_id),url$'")
    return lines.select(F.regexp_extract("value", r"^([^,]*),", 1).alias("rule_id"), F.regexp_extract("value", r"^[^,]*,(.*)$", 1).alias("url")).where("rule_id <> ''")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of .md and .mdx files."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").text(path)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def to_origin(url: str, origin: str):
    """A sitemap's address on the origin that is crawled: its path and query there; null if it is no address."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.concat(F.col(origin), path))


def frontier(pages: DataFrame, seeds: DataFrame, max_urls: int, product_cap: int | None = None) -> DataFrame:
    """The URLs that a crawl of a sitemap would fetch, per site: seeds in order, each URL once, known
    pages only, within the caps. ``seeds``: site, ord, url; ``pages``: site, url, page_type."""
    first = seeds.groupBy("site", "url").agg(F.min("ord").alias("ord"))
    known = first.join(pages.select("site", "url", "page_type").dropDuplicates(["site", "url"]), ["site", "url"])
    if product_cap is not None:
        products = ranked(known.where("page_type = 'product'"), ["site"], "ord", "url").where(F.col("rank") < product_cap).drop("rank", "total")
        known = known.where("page_type IS DISTINCT FROM 'product'").unionByName(products)
    return ranked(known, ["site"], "ord", "url").withColumn("no", F.col("rank") + 1).where(F.col("no") <= max_urls).drop("rank", "total")


def classify(url: str, patterns: list[tuple[str, str]], default: str = "page"):
    """Page type by the first pattern that the URL's path matches."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.coalesce(*[F.when(path.rlike(p), F.lit(t)) for t, p in patterns], F.lit(default))
