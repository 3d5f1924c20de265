"""The audit of a crawl that lies in files: crawl CSV and signals, to an analysis and the lists of its addresses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark, host, normalized
from sitelens.operators import linkgraph, robots, sites
from sitelens.plans import audit
from sitelens.session import stored
from sitelens.sources import artifacts, registry

_D = Spark()
SIGNALS = (
    "robots struct<exists: boolean, raw: string>, llms struct<exists: boolean, valid: boolean, problems: array<string>>, sitemapUrls array<string>, sitemapFiles array<struct<url: string, locCount: bigint>>, "
    "httpProbe struct<reachable: boolean, redirectsToHttps: boolean>, linkGraph struct<edges: array<struct<url: string, internalLinks: array<string>>>>, crawlMeta struct<fetched: bigint, discovered: bigint, capped: boolean, crawledAt: string>"
)
RUNTIME = (
    "available boolean, crux struct<noData: boolean, lcp: struct<category: string>, inp: struct<category: string>, cls: struct<category: string>>, "
    "tls struct<available: boolean, data: struct<issues: array<string>>>, safeBrowsing struct<available: boolean, data: struct<flagged: boolean>>"
)


class Analysis(NamedTuple):
    hits: DataFrame
    findings: DataFrame
    status: DataFrame
    samples: DataFrame
    clusters: DataFrame
    meta: DataFrame


def read_signals(spark: SparkSession, path: str, site: str, runtime_path: str | None = None) -> DataFrame:
    """One row of signals for the site; what a file does not tell is null."""
    s = spark.read.schema(SIGNALS).option("multiLine", True).json(path).limit(1).withColumn("host", F.lit(site))
    raw = robots.parse_files(s.select("host", F.col("robots.raw").alias("raw")), "host", "raw")
    root = robots.allowed(raw.select(F.col("host").alias("site"), F.lit("/").alias("path")), robots.patterns_of(raw, "host"), []).select(F.col("site").alias("host"), F.col("allowed").alias("root_allowed"))
    sizes = F.transform("sitemapFiles", lambda f: f["locCount"])
    out = s.join(raw, "host").join(root, "host").select(
        "*", F.coalesce("robots.exists", F.lit(False)).alias("robots_exists"), F.col("robots.raw").alias("robots_raw"), F.col("llms").isNotNull().alias("llms_known"),
        F.when(F.col("llms.exists"), F.when(F.col("llms.valid"), F.array().cast("array<string>")).otherwise(F.coalesce("llms.problems", F.array(F.lit("not valid"))))).alias("llms_problems"),
        F.array_max(sizes).alias("largest_sitemap"), F.size(F.coalesce("sitemapUrls", F.array().cast("array<string>"))).alias("sitemap_urls"),
        F.coalesce("httpProbe.reachable", F.lit(False)).alias("http_reachable"), F.coalesce("httpProbe.redirectsToHttps", F.lit(False)).alias("http_redirects"),
    )
    if runtime_path is None:
        more = {"cwv": "map<string,string>", "tls_issues": "array<string>", "flagged": "boolean"}
        return out.withColumns({c: F.lit(None).cast(t) for c, t in more.items()})
    r = spark.read.schema(RUNTIME).option("multiLine", True).json(runtime_path).limit(1)
    measured = F.map_filter(F.create_map(*[x for m in ("lcp", "inp", "cls") for x in (F.lit(m), F.col(f"crux.{m}.category"))]), lambda _, v: v.isNotNull())
    seen = r.select(
        F.lit(site).alias("host"), F.when(F.col("available") & F.col("crux").isNotNull() & ~F.coalesce("crux.noData", F.lit(False)), measured).alias("cwv"),
        F.when(F.col("tls.available"), F.col("tls.data.issues")).alias("tls_issues"), F.when(F.col("safeBrowsing.available"), F.col("safeBrowsing.data.flagged")).alias("flagged"),
    )
    return out.join(seen, "host", "left")


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a crawl CSV with their place (``row_no``) and the host of the first row, whose site it is."""
    rows = artifacts.read_csv(spark, path, artifacts.CRAWL_COLUMNS).withColumn("row_no", F.monotonically_increasing_id())
    first = rows.orderBy("row_no").select(F.expr(host(_D, "url"))).first()
    return stored(rows.withColumn("host", F.lit(first[0] if first else "")), "crawl")


def analyze(spark: SparkSession, crawl_csv: str, signals_json: str, rules_dir: str | None = None, runtime_json: str | None = None) -> Analysis:
    """The whole audit of one crawl from its files, by the rules of ``rules_dir`` or the built-in ones."""
    crawl = read_crawl(spark, crawl_csv)
    first = crawl.select("host").first()
    site = first[0] if first else ""
    known = stored(read_signals(spark, signals_json, site, runtime_json), "signals")
    catalogue = registry.catalogue_of(registry.load_rules(spark, rules_dir)) if rules_dir else None

    links = known.select(F.explode("linkGraph.edges").alias("e")).select(F.col("e.url").alias("url"), F.explode("e.internalLinks").alias("dst"))
    edges = stored(links.select(F.expr(normalized(_D, "url")).alias("src"), "dst").distinct(), "edges")
    pages = crawl.select(F.col("host").alias("site"), "row_no", F.expr(normalized(_D, "url")).alias("url"))
    roots = stored(linkgraph.site_roots(pages).select("url"), "roots")
    listed = known.select(F.col("host").alias("site"), F.posexplode("sitemapUrls").alias("ord", "loc")).groupBy("site", "loc").agg(F.min("ord").cast("bigint").alias("ord"))
    patterns = robots.patterns_of(known.where("robots_exists").select("host", "disallow", "allow"), "host")
    depths = linkgraph.click_depth(edges, roots, pages)
    more = {"patterns": stored(patterns, "patterns"), "edges": edges, "roots": roots, "sitemap": stored(listed, "sitemap"), "depths": depths}
    hits = stored(audit.all_hits(crawl, more, catalogue), "hits")

    reached = depths.select(F.lit(site).alias("host"), "url")
    rules = list(catalogue) if catalogue is not None else None
    status = stored(sites.evaluate(sites.page_facts(crawl, reached).join(known, "host"), [r for r in sites.CONDITIONS if rules is None or r in rules], catalogue), "status")
    named = [r for r in (rules or audit.CATALOGUE) if r not in sites.CONDITIONS]
    sizes = known.select("host", F.col("sitemap_urls").cast("bigint").alias("locs"), F.col("crawlMeta.discovered").alias("discovered"))
    return Analysis(hits, audit.findings(hits, crawl, status), audit.statuses(hits, crawl, named, status), audit.samples(hits), audit.clusters(hits), audit.site_meta(crawl, sizes))


def write(analysis: Analysis, out: str) -> None:
    """``analysis`` as JSON lines by part, and every affected address as ``rule_id,url`` lines."""
    for name in ("findings", "status", "samples", "clusters", "meta"):
        getattr(analysis, name).write.mode("overwrite").json(f"{out}/{name}")
    artifacts.write_affected(analysis.hits, f"{out}/affected-urls")
